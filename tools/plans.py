"""Write the physical-plan outline of every registered query to PLANS.md.

usage: python tools/plans.py SF_DIR
For each query: the formatted plan's operator list, pushed filters and read
schemas (plans are taken before execution; AQE may still re-plan joins), and
the number of exchanges and the joins with broadcast off, as at scale.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def outline(df) -> list[str]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    keep = []
    for line in buf.getvalue().splitlines():
        if re.match(r"^\(\d+\) ", line) or line.startswith(("PushedFilters", "ReadSchema")):
            keep.append(line.rstrip()[:220])
    return keep


def exchanges(ops: list[str]) -> tuple[int, int]:
    return (sum(" Exchange" in x and "Broadcast" not in x for x in ops), sum("BroadcastExchange" in x for x in ops))


def main():
    from docmap.plans.registry import REGISTRY
    from docmap.session import get_spark
    sf = sys.argv[1]
    spark = get_spark("local[8]", 16)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = ["# Physical plans of the registered queries", "",
           "Generated by `tools/plans.py`; operator lists of `explain('formatted')`.", ""]
    for name, (fn, _) in sorted(REGISTRY.items()):
        found = []
        for value in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            try:
                found.append(outline(fn(spark, sf)))
            except Exception as e:  # noqa: BLE001
                found.append([f"error: {str(e)[:200]}"])
        ops, wide = ([x for x in lines if x.startswith("(")] for lines in found)
        joins = [re.sub(r"^\(\d+\) | \[.*", "", x).strip() for x in wide if "Join" in x]
        out += [f"## {name}", "", "shuffle exchanges: %d, broadcast exchanges: %d" % exchanges(ops),
                "(broadcast off: %d and %d%s)" % (*exchanges(wide), "; " + ", ".join(joins) if joins else ""), "", "```",
                *found[0], "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
