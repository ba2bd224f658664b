"""All registered queries (importing the modules registers them)."""

from docmap.plans import ledger_queries as _l  # noqa: F401
from docmap.plans import more_queries as _m  # noqa: F401
from docmap.plans import queries as _q  # noqa: F401
from docmap.plans import source_queries as _s  # noqa: F401
from docmap.plans.queries import REGISTRY  # noqa: F401
