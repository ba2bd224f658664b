"""Reference (past mapping) file selection, union and de-duplication.

Products are fixed configuration, so per-file relevance for every product
is a set of column expressions followed by ``stack`` — no join with the
product table at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmap.operators.detect import PRODUCTS

NAME_WORD_MIN = 4          # product-name words longer than 3 letters
FILE_FUZZY_THRESHOLD = 0.85


def _name_parts(name: str) -> list[str]:
    return [w for w in re.findall(r"\w+", name.lower()) if len(w) >= NAME_WORD_MIN]


def _file_words(fname: Column) -> Column:
    # \w+ words of the lower-cased file name (underscore is a word character)
    return F.regexp_extract_all(fname, F.lit(r"(\w+)"), 1)


def relevance_exact(fname_lower: Column, code: str, keywords: list[str], name: str) -> Column:
    """R1 without the fuzzy tier: code +10, keywords +2 each, contained name
    words +1.5, ``mapping`` and ``old`` both present +0.5."""
    s = F.when(F.instr(fname_lower, code.lower()) > 0, 10.0).otherwise(0.0)
    for kw in keywords:
        s = s + F.when(F.instr(fname_lower, kw) > 0, 2.0).otherwise(0.0)
    for part in _name_parts(name):
        s = s + F.when(F.instr(fname_lower, part) > 0, 1.5).otherwise(0.0)
    s = s + F.when((F.instr(fname_lower, "mapping") > 0) & (F.instr(fname_lower, "old") > 0), 0.5).otherwise(0.0)
    return s


def file_relevance(files: DataFrame, name_col: str = "file_name", fuzzy: bool = True) -> DataFrame:
    """One row per (file, product) with its relevance score.

    The fuzzy tier (+1.0 when a name word is not contained but some file-name
    word has similarity > 0.85) runs on the distinct (word, part) pairs only.
    """
    fl = F.lower(F.col(name_col))
    scored = files.select("*", F.inline(F.array(*[
        F.struct(F.lit(p[0]).alias("product_code"), F.lit(d).alias("def_order"),
                 relevance_exact(fl, p[0], p[2], p[1]).alias("score"))
        for d, p in enumerate(PRODUCTS)])))
    if not fuzzy:
        return scored
    # fuzzy tier on distinct words: words x name parts not contained in the name
    spark = files.sparkSession
    parts = spark.createDataFrame(
        [(p[0], part) for p in PRODUCTS for part in _name_parts(p[1])], "product_code string, part string")
    words = (files.select(name_col, F.explode(_file_words(F.lower(F.col(name_col)))).alias("word")).distinct())
    vocab = words.select("word").distinct()
    from docmap.functions.similarity import fuzzy_matches
    hits = fuzzy_matches(vocab, "word", parts, "part", FILE_FUZZY_THRESHOLD)  # ratio(part, word)
    per_file = (words.join(hits.select("word", "product_code", "part"), "word")
                .where(F.instr(F.lower(F.col(name_col)), F.col("part")) == 0)
                .select(name_col, "product_code", "part").distinct()
                .groupBy(name_col, "product_code").agg(F.count(F.lit(1)).cast("double").alias("fuzzy_points")))
    return (scored.join(per_file, [name_col, "product_code"], "left")
            .withColumn("score", F.col("score") + F.coalesce("fuzzy_points", F.lit(0.0)))
            .drop("fuzzy_points"))


def relevant_files(scored: DataFrame, max_files: int | None, product_code: str | None = None,
                   threshold: float = 1.0, name_col: str = "file_name") -> DataFrame:
    """R2 (+ the top-N of R3): files with score > 0 and >= threshold, ranked by
    score desc then name.  ``max_files`` keeps only the first N per product (None:
    all are kept; ``row_number() <= N``: a partial group limit runs before the shuffle,
    so a product with many files never gathers them in one task)."""
    s = scored.where((F.col("score") > 0) & (F.col("score") >= threshold))
    if product_code is not None:
        s = s.where(F.col("product_code") == product_code)
    w = Window.partitionBy("product_code").orderBy(F.desc("score"), name_col)
    r = s.withColumn("file_rank", F.row_number().over(w))
    return r.where(F.col("file_rank") <= max_files) if max_files is not None else r


def union_ranked(frames: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """Union of loaded files (name, rank, rows) with ``source_file`` and
    ``file_rank``; columns are the union of all files' columns."""
    out = None
    for name, rank, df in frames:
        t = df.withColumn("source_file", F.lit(name)).withColumn("file_rank", F.lit(rank))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def first_per_group(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keep the first row per key by ``order_cols``.

    An aggregate of ``min(struct(order..., row...))`` (planned sort-based,
    since the buffer is a struct) with partial aggregation on the map side:
    each task keeps one row per key before the shuffle, so a hot key never
    gathers its rows in one task.  Select the columns that are wanted before:
    all of them are shipped.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    st = F.struct(*[c for c in order_cols if c not in keys], *rest)
    return df.groupBy(*keys).agg(F.min(st).alias("_f")).select(
        *[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in df.columns])


def dedupe_mappings(union: DataFrame, row_order: list[str]) -> DataFrame:
    """One row per (source_node, target_column): most relevant file first, then input order."""
    return first_per_group(union, ["source_node", "target_column"], ["file_rank", *row_order])


def with_fallback(rows: DataFrame, requested: list[str], key: str = "product_code") -> DataFrame:
    """Rows of each requested product; a product without rows falls back
    to all rows.  No join: products present are found by one aggregate (size
    bounded by ``requested``), fallback rows are generated by ``explode``."""
    present = {r[0] for r in rows.where(F.col(key).isin(requested)).select(key).distinct().collect()}
    missing = [p for p in requested if p not in present]
    own = F.when(F.col(key).isin([p for p in requested if p in present]), F.array(F.col(key)))
    fb = F.array(*[F.lit(p) for p in missing]) if missing else F.array().cast("array<string>")
    req = F.array_union(F.coalesce(own, F.array().cast("array<string>")), fb)
    return (rows.select("*", F.explode(req).alias("requested_product"))
            .withColumn("is_fallback", F.col("requested_product").isin(missing) if missing else F.lit(False)))


def with_generic_file(scored: DataFrame, products: list[str], generic: str, name_col: str = "file_name",
                      threshold: float = 1.0) -> DataFrame:
    """Relevant files of each product; a product without any gets the
    generic file (score 0.0, ``is_generic``).

    ``products`` is configuration: one row for each is left-joined with the
    number of its files, which Spark counts in one aggregate.
    """
    found = scored.where((F.col("score") > 0) & (F.col("score") >= threshold) & F.col("product_code").isin(products))
    wanted = scored.sparkSession.createDataFrame([(p,) for p in products], "product_code string")
    missing = wanted.join(found.select("product_code").distinct(), "product_code", "left_anti").select(
        F.lit(generic).alias(name_col), "product_code", F.lit(0.0).alias("score"), F.lit(True).alias("is_generic"))
    return found.select(name_col, "product_code", "score", F.lit(False).alias("is_generic")).unionByName(missing)


# ------------------------------------------------------------- R7 - R10
# File-name patterns of the rule-based classifier (first match wins).
CLASS_RULES = [
    ("historical_mapping", r"(mapping|map_|_map)"),
    ("data_dictionary", r"(dictionary|glossary|_dict)"),
    ("schema_definition", r"(schema|ddl|definition)"),
    ("reference_data", r"(reference|lookup|code)"),
]


def classify_files(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """R7 (rule-based): category and 0-100 relevance.  Relevance is the best
    exact R1 product score scaled by 5 and capped at 100."""
    fl = F.lower(F.col(name_col))
    cat = F.lit("not_relevant")
    for c, pat in reversed(CLASS_RULES):
        cat = F.when(fl.rlike(pat), c).otherwise(cat)
    best = F.greatest(*[relevance_exact(fl, p[0], p[2], p[1]) for p in PRODUCTS])
    return files.select("*", cat.alias("category"),
                        F.least(F.lit(100.0), best * 5).alias("relevance"))


def top_per_category(classified: DataFrame, n: int, name_col: str = "file_name",
                     min_relevance: float = 20.0) -> DataFrame:
    """Relevant files (class != not_relevant, relevance > 20), top ``n``
    per category by relevance desc, ties by name.  ``row_number() <= n``
    is planned as a partial WindowGroupLimit before the shuffle."""
    f = classified.where((F.col("category") != "not_relevant") & (F.col("relevance") > min_relevance))
    w = Window.partitionBy("category").orderBy(F.desc("relevance"), name_col)
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def category_summary(loaded: DataFrame, rows_col: str = "row_count") -> DataFrame:
    """Files and rows per category."""
    return loaded.groupBy("category").agg(F.count(F.lit(1)).alias("files"),
                                          F.sum(rows_col).alias("rows"))
