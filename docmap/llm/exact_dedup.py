"""Exact duplicate removal by 128-bit content hash with byte comparison.

Texts are equal when they are identical after lower-casing A-Z only.  Rows
are grouped by the MD5 of the normalised text; only (id, hash) pairs are
shuffled for that, with map-side partial aggregation, so a group holding a
third of all rows is a handful of partial counts.  Rows of groups with more
than one member are then compared byte by byte with one text of their group
(a join that Spark may split where it is skewed); rows that only share the
hash get a group of their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import ascii_lower, stored


def content_hash(c: Column) -> Column:
    """128-bit MD5 of the UTF-8 bytes, as 16 bytes."""
    return F.unhex(F.md5(c))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                hash_fn: Callable[[Column], Column] = content_hash,
                broadcast_rows: int = 300_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed, groups, collisions) of the documents, see ``exact_dedup``.

    ``keyed``: one stored row per document (_id, _h, _sha); ``groups``: one
    row per hash (_h, _n, _keep); ``collisions``: rows whose text differs
    from the text of their hash group (_id, _h, _sha, _n, _keep), normally
    empty.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
    rows = rows.withColumn("_h", hash_fn(F.col("_norm")))
    keyed = stored(rows.select("_id", "_h", F.sha2("_norm", 256).alias("_sha")), "exact-keys")
    # stored: joins with them then have plain exchanges, which Spark may split
    # where one hash has many rows
    groups = stored(keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep")), "exact-groups")
    several = groups.filter("_n > 1").select("_h", "_keep")
    if several.count() <= broadcast_rows:  # 24 bytes each; else texts are shuffled by hash
        several = F.broadcast(several)
    # one text per group of copies: that of the row that stays (the least
    # such text, should one id carry several)
    shared = rows.join(several, "_h")
    first = (shared.filter(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_h")
             .agg(F.min("_norm").alias("_first")))
    differ = stored(shared.join(first, "_h").filter("_norm != _first")
                    .select("_id", "_h", "_norm", F.sha2("_norm", 256).alias("_sha")), "exact-collisions")
    own = differ.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep"))
    collisions = differ.join(own, ["_h", "_norm"]).select("_id", "_h", "_sha", "_n", "_keep")
    return keyed, groups, collisions


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document, dropped ones too: ``id_col``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Defined results: a null text counts as empty; a null id is a document of
    its own row and stays only if no copy has an id; rows that repeat an id
    and a text are counted each and get the same answer; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    keyed, groups, collisions = text_groups(docs, id_col, text_col, keep, hash_fn)
    pick = F.min if keep == "smallest" else F.max
    plain = keyed.join(groups, "_h")
    if not collisions.isEmpty():
        # take the rows with other texts out of their hash groups
        moved = collisions.select("_id", "_h", "_sha").distinct()
        rest = keyed.join(moved, (keyed["_h"] == moved["_h"]) & (keyed["_sha"] == moved["_sha"])
                          & keyed["_id"].eqNullSafe(moved["_id"]), "left_anti")
        again = rest.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep"))
        plain = rest.join(again, "_h").select("_id", "_sha", "_n", "_keep").unionByName(
            collisions.select("_id", "_sha", "_n", "_keep"))
    return plain.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "smallest") -> DataFrame:
    """The documents without exact copies, with all their columns.

    Of rows that repeat the id and the text of the one that stays, the least
    row (by all columns in order) stays.
    """
    marked = exact_dedup(docs, id_col, text_col, keep)
    keepers = (marked.filter("kept").groupBy(F.col("text_sha256").alias("_sha"))
               .agg(F.first(id_col).alias("_keep"), F.count(F.lit(1)).alias("_times")))
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("_row"), F.col(id_col).alias("_id"), F.sha2(norm, 256).alias("_s"))
    found = rows.join(keepers, (F.col("_s") == F.col("_sha")) & F.col("_id").eqNullSafe(F.col("_keep")))
    once = found.filter("_times = 1").select("_row")
    repeated = found.filter("_times > 1").groupBy("_s").agg(F.min("_row").alias("_row")).select("_row")
    return once.unionByName(repeated).select("_row.*")
