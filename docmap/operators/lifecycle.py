"""Mapping ledger lifecycle.

Updates are joins + ``coalesce`` producing a new snapshot (Parquet has no
row-level MERGE); callers write the snapshot to a new location and never
overwrite what they are reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_mapping_ids(pred: DataFrame, order_cols: list[str], doc_col: str = "xml_id") -> DataFrame:
    """K3: ``MAP-{xml_id}-{nnnn}`` numbered from 0 in input order within a
    document; Pending / Not Started; NULL logic -> ''.  Numbering is a
    distributed row number (a document with a huge share of the rows is
    spread over many range partitions, never sorted in one task)."""
    from docmap.operators.cost import row_number_within
    from docmap.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(pred.sparkSession)
    numbered = row_number_within(pred, [doc_col], order_cols, "_n")
    return (numbered.withColumn("mapping_id", F.format_string("MAP-%s-%04d", F.col(doc_col), F.col("_n") - 1))
            .drop("_n")
            .withColumn("approval_status", F.lit("Pending"))
            .withColumn("execution_status", F.lit("Not Started"))
            .withColumn("transformation_logic", F.coalesce("transformation_logic", F.lit(""))))


def pending(ledger: DataFrame) -> DataFrame:
    """L1: Pending mappings, ordered by document then confidence desc."""
    return ledger.where(F.col("approval_status") == "Pending") \
        .orderBy("xml_id", F.desc("confidence_score"))


def executable(ledger: DataFrame) -> DataFrame:
    """L2: Approved and not yet run successfully (Not Started / Failed)."""
    return ledger.where((F.col("approval_status") == "Approved")
                        & F.col("execution_status").isin("Not Started", "Failed")).orderBy("xml_id")


def apply_updates(ledger: DataFrame, updates: DataFrame, keys: list[str],
                  columns: list[str], order_cols: list[str] | None = None) -> DataFrame:
    """Update ``columns`` by key from ``updates`` (NULL keeps the old value).

    Several updates of one key are reduced to the last one by ``order_cols``
    (by default all their columns), so a ledger row is never multiplied.
    """
    order = [c for c in (order_cols or []) if c in updates.columns]
    last = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                          *[F.col(c).alias(f"_u_{c}") for c in columns]))
    u = (updates.groupBy(*keys).agg(last.alias("_last"))
         .select(*keys, *[F.col(f"_last._u_{c}").alias(f"_u_{c}") for c in columns], F.lit(True).alias("_hit")))
    new = {c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) for c in columns}
    return (ledger.join(u, keys, "left")
            .withColumns({**new, "updated": F.coalesce(F.col("_hit"), F.lit(False))})
            .drop(*[f"_u_{c}" for c in columns], "_hit"))


def approve(ledger: DataFrame, approvals: DataFrame) -> DataFrame:
    """L3: approvals (mapping_id, approved_by, approved_date, transformation_logic, user_notes)."""
    a = approvals.withColumn("approval_status", F.lit("Approved"))
    cols = [c for c in ("approval_status", "approved_by", "approved_date", "transformation_logic", "user_notes")
            if c in a.columns]
    return apply_updates(ledger, a, ["mapping_id"], cols, ["approved_date"])


def reject_documents(ledger: DataFrame, docs: DataFrame, doc_col: str = "xml_id") -> DataFrame:
    """L4: every mapping of the listed documents becomes Rejected (any state)."""
    d = docs.select(doc_col).distinct().withColumn("_rej", F.lit(True))
    j = ledger.join(d, doc_col, "left")
    hit = F.coalesce(F.col("_rej"), F.lit(False))
    return (j.withColumn("approval_status", F.when(hit, F.lit("Rejected")).otherwise(F.col("approval_status")))
            .withColumn("rejected", hit).drop("_rej"))


def update_execution(ledger: DataFrame, results: DataFrame, doc_col: str = "xml_id") -> DataFrame:
    """Execution status by (document, target_table) with id, time, error."""
    cols = [c for c in ("execution_status", "last_execution_id", "last_execution_at", "execution_error")
            if c in results.columns]
    return apply_updates(ledger, results, [doc_col, "target_table"], cols, ["last_execution_at"])


def latest(df: DataFrame, order_col: str, tiebreak: list[str], n: int = 10) -> DataFrame:
    """Newest ``n`` rows (TakeOrderedAndProject: a per-task top-n, then a merge)."""
    return df.orderBy(F.desc(order_col), *[F.desc(t) for t in tiebreak]).limit(n)


def lower_columns(df: DataFrame) -> DataFrame:
    """All column names lower-cased."""
    return df.toDF(*[c.lower() for c in df.columns])


def run_status(ok: Column, failed: Column) -> Column:
    """Success (no failures), Partial (both), Failed (no successes)."""
    return (F.when((failed == 0) & (ok > 0), "Success")
            .when((failed > 0) & (ok > 0), "Partial")
            .otherwise("Failed"))


def execution_record(results: DataFrame, doc_col: str = "xml_id") -> DataFrame:
    """Per document: comma-joined succeeded and failed tables (sorted) and status.

    ``results``: doc, target_table, ok (bool).  The table lists are
    bounded by the number of target tables.
    """
    g = results.groupBy(doc_col).agg(
        F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("target_table")))).alias("_ok"),
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("target_table")))).alias("_failed"))
    return g.select(
        doc_col, F.array_join("_ok", ",").alias("tables_succeeded"), F.array_join("_failed", ",").alias("tables_failed"),
        F.size("_ok").cast("bigint").alias("n_ok"), F.size("_failed").cast("bigint").alias("n_failed"),
        run_status(F.size("_ok"), F.size("_failed")).alias("status"))


def staging_status(stage: DataFrame, doc_col: str = "xml_id") -> DataFrame:
    """Per document total, processed, pending (NULL processed counts as neither)."""
    return stage.groupBy(doc_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("processed") == F.lit(True)).alias("processed"),
        F.count_if(F.col("processed") == F.lit(False)).alias("pending"))


def document_summary(ledger: DataFrame, doc_col: str = "xml_id") -> DataFrame:
    """Mappings and distinct target tables per document."""
    return ledger.groupBy(doc_col).agg(F.count(F.lit(1)).alias("mapping_count"),
                                       F.count_distinct("target_table").alias("table_count"))


def table_counts(ledger: DataFrame) -> DataFrame:
    """Mappings per target table."""
    return ledger.groupBy("target_table").agg(F.count(F.lit(1)).alias("mapping_count"))


def choose_stage(common: DataFrame, per_doc: DataFrame, doc_col: str = "xml_id") -> DataFrame:
    """The common stage when it has rows for a document, else the
    per-document stage.  Ranked union + per-document minimum rank."""
    u = (common.withColumn("stage_rank", F.lit(0)).withColumn("stage_name", F.lit("common"))
         .unionByName(per_doc.withColumn("stage_rank", F.lit(1)).withColumn("stage_name", F.lit("document"))))
    best = u.groupBy(doc_col).agg(F.min("stage_rank").alias("stage_rank"))
    return u.join(best, [doc_col, "stage_rank"])
