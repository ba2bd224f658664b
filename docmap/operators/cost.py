"""Cost model (M11) and usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Token estimate per item and prices per 1K tokens.
TOKENS_PER_NODE = 50
TOKENS_PER_COLUMN = 40
TOKENS_PER_HISTORY_ROW = 60
TOKENS_PROMPT = 500
OUTPUT_TOKENS_PER_COLUMN = 80
PRICES = {
    "gpt-4o-2024-08-06": ("0.0025", "0.01"),
    "text-embedding-3-small": ("0.00002", "0.0"),
}
MONEY = "decimal(20,8)"


def estimate_cost(df: DataFrame, nodes: Column, columns: Column, history: Column,
                  model: str = "gpt-4o-2024-08-06") -> DataFrame:
    """input = 50n + 40c + 60h + 500, output = 80c; cost from the per-1K price."""
    pin, pout = PRICES[model]
    tin = (nodes * TOKENS_PER_NODE + columns * TOKENS_PER_COLUMN + history * TOKENS_PER_HISTORY_ROW
           + TOKENS_PROMPT).cast("bigint")
    tout = (columns * OUTPUT_TOKENS_PER_COLUMN).cast("bigint")
    cin = (tin.cast(MONEY) * F.lit(pin).cast(MONEY) / 1000).cast(MONEY)
    cout = (tout.cast(MONEY) * F.lit(pout).cast(MONEY) / 1000).cast(MONEY)
    return df.select("*", tin.alias("input_tokens"), tout.alias("output_tokens"),
                     cin.alias("input_cost"), cout.alias("output_cost"),
                     (cin + cout).cast(MONEY).alias("total_cost"), F.lit(model).alias("model"))


def usage_summary(calls: DataFrame, cost_col: str = "total_cost") -> DataFrame:
    """Calls, total cost, average per call (0 when there are none)."""
    return calls.agg(F.count(F.lit(1)).alias("calls"),
                     F.coalesce(F.sum(cost_col), F.lit(0)).cast(MONEY).alias("total_cost"),
                     F.coalesce(F.avg(cost_col), F.lit(0)).cast(MONEY).alias("avg_cost"))


def running_sum(df: DataFrame, order_cols: list[str], value_col: str, out_col: str = "cumulative",
                partitions: int | None = None) -> DataFrame:
    """Global running sum ordered by ``order_cols`` (a unique order) without
    moving all rows into one task.

    1. range-partition by the full order (balanced even if one value is hot,
       because the unique tiebreak splits it) and write the rows with their
       partition's number to scratch, so the numbers are stable on retries;
    2. running sum inside each partition (window per partition id);
    3. per-partition totals (one row per partition) -> prefix offsets
       (small, broadcast) -> added back.
    """
    from docmap.session import partitions_for, written
    n = partitions or partitions_for(df)
    ranged = written(df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value_col).over(w))
    totals = ranged.groupBy("_pid").agg(F.sum(value_col).alias("_tot"))
    offs = totals.withColumn(
        "_off", F.coalesce(F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    # ``offs`` has one row per partition: its size is bounded by ``n``.
    return (local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(out_col, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off"))


def row_number_within(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                      out_col: str = "row_number", partitions: int | None = None) -> DataFrame:
    """``row_number()`` over (partition by ``partition_cols`` order by
    ``order_cols``, a unique order) without gathering a hot group in one task.

    Range-partition by (group, order) and write to scratch (stable partition
    numbers); number rows inside each (range partition, group).  Only the first
    group of a range partition can have begun in an earlier one, so the offsets
    are one row per range partition at most, a prefix sum over their ends,
    which is broadcast.
    """
    from docmap.session import partitions_for, written
    n = partitions or partitions_for(df)
    ranged = written(df.repartitionByRange(n, *partition_cols, *order_cols).withColumn("_pid", F.spark_partition_id()), "ranges")
    group = F.struct(*partition_cols)
    w = Window.partitionBy("_pid", *partition_cols).orderBy(*order_cols)
    local = ranged.withColumn("_local", F.row_number().over(w))
    # the last row of each range partition tells its last group and how many
    # rows of it are there; the first group is the one of the first row
    ends = ranged.groupBy("_pid").agg(F.min(group).alias("_first"), F.max(group).alias("_last"))
    counts = (ranged.join(F.broadcast(ends), "_pid").where(group.eqNullSafe(F.col("_last")))
              .groupBy("_pid", F.col("_last").alias("_group")).agg(F.count(F.lit(1)).alias("_cnt")))
    counts = counts.select(F.col("_pid").alias("_cpid"), "_cnt")
    # rows of its last group up to the end of a range partition; the next one
    # (there is a row for each that is not empty) takes them over if it goes on
    # with that group
    so_far = Window.partitionBy("_last").orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    one_each = ends.join(F.broadcast(counts), F.col("_pid") == F.col("_cpid")).withColumn("_sum", F.sum("_cnt").over(so_far))
    in_order = Window.orderBy("_pid")
    offs = one_each.withColumns({"_before": F.lag("_sum").over(in_order), "_group": F.lag("_last").over(in_order)})
    offs = offs.where(F.col("_before").isNotNull() & F.col("_group").eqNullSafe(F.col("_first"))).select(
        F.col("_pid").alias("_opid"), "_first", F.col("_before").alias("_off"))
    return (local.join(F.broadcast(offs), (F.col("_pid") == F.col("_opid")) & group.eqNullSafe(F.col("_first")), "left")
            .withColumn(out_col, (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("int"))
            .drop("_pid", "_local", "_off", "_opid", "_first"))
