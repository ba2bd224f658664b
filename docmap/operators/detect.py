"""Product detection by weighted evidence.

Per document and product:
  keywords contained in the lower-cased document text   +1.0 each  (D1)
  node pattern equal to a lower-cased tag                +2.0       (D2)
  otherwise a tag with similarity > 0.8                  +1.5       (D3)
  attribute pattern equal to an attribute name           +1.5       (D4)
  otherwise an attribute name with similarity > 0.8      +1.0       (D4)
  product code contained in the text                     +3.0       (D5)
normalized by the product's maximum (D6); best product, NULL below
``min_score`` (D7); per-product detail rows (D8).

All evidence is collected where the document is parsed, once, in an
Arrow-batched UDF that returns one small row of counts: its text is searched
once for the keywords and codes of all products (one automaton, whatever their
number), and each worker keeps which patterns a tag matches, so the fuzzy
ratio is computed once per distinct tag there.  Nothing is shuffled, joined or
checkpointed: scores of all products are plain expressions over that row.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.functions.patterns import contained_counts, group_counts
from docmap.session import ensure_worker_code

# Product definitions of the detector
# (code, name, keywords, node patterns, attribute patterns).
PRODUCTS = [
    ("PA001", "Personal Auto Insurance",
     ["auto", "vehicle", "car", "driver", "vin", "automobile", "motorvehicle"],
     ["Vehicle", "Driver", "VIN", "Make", "Model", "VehicleInfo"],
     ["vehicleidentificationnum", "vehiclevin", "driverage"]),
    ("HO003", "Homeowners Insurance",
     ["home", "homeowner", "dwelling", "property", "residence", "building", "house"],
     ["Dwelling", "PropertyDetails", "BuildingYear", "ConstructionType", "Occupancy"],
     ["squarefootage", "buildingYear", "propertyvalue"]),
    ("CP001", "Commercial Property Insurance",
     ["commercial", "business", "office", "businessproperty", "businesspersonalproperty"],
     ["CommercialBuilding", "BusinessProperty", "BusinessName", "OccupancyType"],
     ["businessname", "commercialbuilding"]),
    ("UMB001", "Personal Umbrella Insurance",
     ["umbrella", "excess", "excessliability", "personalliability", "underlyingretention"],
     ["Umbrella", "ExcessLiability", "UnderlyingRetention"],
     ["underlyingretention", "excessliability"]),
    ("WC001", "Workers Compensation",
     ["workers", "workerscomp", "workerscompensation", "employee", "payroll"],
     ["Employee", "Payroll", "WorkersComp", "Occupation"],
     ["employeecount", "payrollamount"]),
]

# Keyword lists of the simple (count-only) detector.
SIMPLE_KEYWORDS = [
    ("PA001", ["PersonalAuto", "Auto", "Vehicle", "Car", "Driver", "VIN"]),
    ("HO003", ["Homeowners", "Property", "Dwelling", "Residence", "Building"]),
    ("CP001", ["Commercial", "BusinessProperty", "Office", "CommercialBuilding"]),
    ("UMB001", ["Umbrella", "ExcessLiability", "PersonalLiability"]),
    ("WC001", ["WorkersComp", "WorkersCompensation", "Employee"]),
]

TAG_THRESHOLD = 0.8


def max_score(p) -> float:
    return len(p[2]) * 1.0 + len(p[3]) * 2.0 + len(p[4]) * 1.5 + 3.0


# A parser drops comments, processing instructions and the prolog.
_NOT_CONTENT = re.compile(r"<(?:!--.*?--|\?.*?\?)>", re.DOTALL)


def document_text(raw: str) -> str:
    """Lower-cased text as a parser would re-serialize it: no prolog, no comments."""
    return _NOT_CONTENT.sub("", raw).lower()


def keyword_detect(df: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    """Per product the number of its keywords contained in the lower-cased
    text; best = highest count, ties to the first product; confidence = count.
    Each text is searched once for the keywords of all products."""
    ensure_worker_code(df.sparkSession)
    codes = [code for code, _ in SIMPLE_KEYWORDS]
    counts = contained_counts(F.lower(F.col(text_col)), [[w.lower() for w in kws] for _, kws in SIMPLE_KEYWORDS])
    low = df.select(*key_cols, counts.alias("_n"))
    cols = low.select(*key_cols, *[F.coalesce(F.col("_n")[i], F.lit(0)).alias(f"kw_{c.lower()}") for i, c in enumerate(codes)])
    kw = {code: F.col(f"kw_{code.lower()}") for code in codes}
    best = F.greatest(*kw.values())
    return cols.select("*", _first_of({code: c == best for code, c in kw.items()}).alias("detected_product"), best.alias("confidence"))


def _first_of(choices: dict[str, Column]) -> Column:
    """The first name whose condition holds."""
    pick = None
    for name, condition in choices.items():
        pick = F.when(condition, name) if pick is None else pick.when(condition, name)
    return pick


class TermPatterns(dict):
    """(kind, term) -> [(product, pattern, exact, similarity)] of the patterns
    that the term matches; ``limit`` bounds the terms remembered."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, key: tuple[str, str]) -> list[tuple[int, int, bool, float]]:
        kind, term = key
        hits = []
        for d, p in enumerate(PRODUCTS):
            for j, pattern in enumerate(p[3] if kind == "node" else p[4]):
                pattern = pattern.lower()
                if pattern == term:
                    hits.append((d, j, True, 0.0))
                # 2 * shorter / both lengths is the most the ratio can be
                elif 2 * min(len(pattern), len(term)) > TAG_THRESHOLD * (len(pattern) + len(term)):
                    r = SequenceMatcher(None, pattern, term).ratio()
                    if r > TAG_THRESHOLD:
                        hits.append((d, j, False, r))
        if len(self) >= self.limit:
            self.clear()
        self[key] = hits
        return hits


# Points of an exact and of a fuzzy match.
POINTS = {"node": (2.0, 1.5), "attr": (1.5, 1.0)}
# One row of evidence per document; the lists go by product.
EVIDENCE_TYPE = T.StructType([
    T.StructField("parsed", T.BooleanType()), T.StructField("keyword_matches", T.ArrayType(T.IntegerType())),
    T.StructField("code_found", T.ArrayType(T.IntegerType())),
    T.StructField("node_points", T.ArrayType(T.DoubleType())), T.StructField("node_matches", T.ArrayType(T.LongType())),
    T.StructField("fuzzy_score", T.ArrayType(T.DoubleType())), T.StructField("attr_points", T.ArrayType(T.DoubleType())),
    T.StructField("attribute_matches", T.ArrayType(T.LongType()))])


_TAG = attrgetter("tag")


def document_terms(raw: str | None):
    """[(kind, lower-cased term)], tags and then attribute names, of each kind in
    document order and each once; None when the document does not parse."""
    from docmap.functions.xmlnodes import local_name, parse
    root, _ = parse(raw)
    if root is None:
        return None
    # names as they are written are told apart first, by far fewer steps of Python
    tags = dict.fromkeys(map(_TAG, root.iter()))
    attributes = dict.fromkeys(a for el in root.iter() for a in el.keys())
    return list(dict.fromkeys([("node", local_name(t).lower()) for t in tags if isinstance(t, str)]
                              + [("attr", local_name(a).lower()) for a in attributes]))


def term_evidence(raw: str | None, patterns: TermPatterns, keywords=None, codes=None) -> tuple:
    """One row of EVIDENCE_TYPE (lists by product): keywords and codes in the
    text (D1, D5), and of each pattern an exact match, else the first similar
    term in document order (D2-D4)."""
    zeros, none = [0.0] * len(PRODUCTS), [0] * len(PRODUCTS)
    terms = document_terms(raw)
    text = document_text(raw) if raw is not None and keywords else None
    words = (keywords(text), codes(text)) if text is not None else (none, none)
    node_points, nodes, fuzzy, attr_points, attrs = zeros[:], none[:], zeros[:], zeros[:], none[:]
    best: dict[tuple[str, int, int], tuple[bool, float]] = {}
    for kind, term in terms or ():
        for d, j, exact, similarity in patterns[kind, term]:
            if exact or (kind, d, j) not in best:
                best[kind, d, j] = (exact, similarity)
    for (kind, d, _), (exact, similarity) in best.items():
        points = POINTS[kind][0 if exact else 1]
        if kind == "node":
            node_points[d] += points
            nodes[d] += 1
            fuzzy[d] += similarity
        else:
            attr_points[d] += points
            attrs[d] += 1
    return (terms is not None, *words, node_points, nodes, fuzzy, attr_points, attrs)


_PATTERNS = TermPatterns()
_KEYWORDS = group_counts([[w.lower() for w in p[2]] for p in PRODUCTS])
_CODES = group_counts([[p[0].lower()] for p in PRODUCTS])


@F.pandas_udf(EVIDENCE_TYPE)
def _evidence(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([term_evidence(r, _PATTERNS, _KEYWORDS, _CODES) for r in raw], columns=EVIDENCE_TYPE.names)


DETAIL = ["raw_score", "product_name", "keyword_matches", "node_matches", "attribute_matches", "fuzzy_score"]


def _scored(docs: DataFrame, key_cols: list[str], raw_col: str) -> tuple[DataFrame, list[dict[str, Column]]]:
    """The evidence of every document (one parse and one search each), with the
    raw score of each product as ``_s0``, ``_s1``, .., and per product the
    columns of its detail row."""
    ensure_worker_code(docs.sparkSession)
    base = docs.select(*key_cols, _evidence(F.col(raw_col)).alias("_e"))
    at = lambda c, d: F.col(f"_e.{c}")[d]
    base = base.withColumns({f"_s{d}": at("keyword_matches", d) + at("node_points", d) + at("attr_points", d) + F.lit(3.0) * at("code_found", d)
                             for d in range(len(PRODUCTS))})
    rows = [{"product_code": F.lit(p[0]), "product_name": F.lit(p[1]), "def_order": F.lit(d), "raw_score": F.col(f"_s{d}"),
             "normalized_score": F.col(f"_s{d}") / max_score(p), "keyword_matches": at("keyword_matches", d),
             "node_matches": at("node_matches", d), "attribute_matches": at("attribute_matches", d), "fuzzy_score": at("fuzzy_score", d)}
            for d, p in enumerate(PRODUCTS)]
    return base, rows


def product_scores(docs: DataFrame, key_cols: list[str], raw_col: str = "raw_xml") -> DataFrame:
    """One row per (document, product) with raw and normalized score and
    the number of matches of each kind."""
    base, rows = _scored(docs, key_cols, raw_col)
    return base.select(*key_cols, F.col("_e.parsed").alias("parsed"), F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])))


def detect_products(docs: DataFrame, key_cols: list[str], raw_col: str = "raw_xml", min_score: float = 0.2) -> DataFrame:
    """Best product per document (ties to definition order) with its
    detail; code NULL and confidence 0.0 when the best is below ``min_score``
    or the document does not parse (then without detail)."""
    base, rows = _scored(docs, key_cols, raw_col)
    base = base.withColumn("_best", F.greatest(*[r["normalized_score"] for r in rows]))
    place = None
    for d, r in enumerate(rows):
        hit = r["normalized_score"] == F.col("_best")
        place = F.when(hit, d) if place is None else place.when(hit, d)
    base = base.withColumn("_d", place)
    parsed = F.col("_e.parsed")
    ok = parsed & (F.col("_best") >= min_score)

    def of_best(name: str) -> Column:
        c = None
        for d, r in enumerate(rows):
            c = F.when(F.col("_d") == d, r[name]) if c is None else c.when(F.col("_d") == d, r[name])
        return c
    return base.select(*key_cols, F.when(ok, of_best("product_code")).alias("product_code"),
                       F.when(ok, F.col("_best")).otherwise(0.0).alias("confidence"),
                       *[F.when(parsed, of_best(c)).alias(c) for c in DETAIL])


def top_products(scores: DataFrame, key_cols: list[str], n: int = 3) -> DataFrame:
    """D8 ranking: top ``n`` products per document by normalized score."""
    from pyspark.sql import Window
    w = Window.partitionBy(*key_cols).orderBy(F.desc("normalized_score"), "def_order")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
