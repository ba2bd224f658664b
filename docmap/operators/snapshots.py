"""Versioned ledger snapshots that rewrite only what changed.

A ledger is kept as Parquet, partitioned into buckets by a hash or a given
expression.  An update finds the buckets its keys fall into, reads, updates and
writes those alone into a new version folder, and adds a manifest that says
which version holds each bucket: buckets without updates are linked, not
copied.  Nothing that is read is overwritten; a version is visible once its
manifest is written, so an update that dies half way leaves the last one as it
was, and running it again gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmap.operators.lifecycle import apply_updates

BUCKET = "_bucket"


def hash_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("bucket int, version int").parquet(f"{path}/manifest-{version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest was written whole, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.getName().split("-")[1]) for n in names
                  if n.getName().startswith("manifest-") and fs.exists(hadoop_path(n, "_SUCCESS")))


def create_snapshot(ledger: DataFrame, path: str, bucket: Column) -> None:
    """Version 0 of a ledger."""
    rows = ledger.withColumn(BUCKET, bucket.cast("int"))
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data-0")
    held = ledger.sparkSession.read.parquet(f"{path}/data-0").groupBy(F.col(BUCKET).alias("bucket")).agg(F.lit(0).alias("version"))
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-0")


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The ledger as of a version (the last one by default), or some of its
    buckets; only their folders are listed and read."""
    version = versions(spark, path)[-1] if version is None else version
    held: dict[int, list[int]] = {}
    for r in _manifest(spark, path, version).collect():  # one row per bucket
        if buckets is None or r.bucket in buckets:
            held.setdefault(r.version, []).append(r.bucket)
    schema = spark.read.parquet(f"{path}/data-0").schema
    parts = [spark.read.schema(schema).option("basePath", f"{path}/data-{v}").parquet(
        *[f"{path}/data-{v}/{BUCKET}={b}" for b in sorted(found)]) for v, found in sorted(held.items())]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def update_snapshot(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], columns: list[str], bucket: Column,
                    order_cols: list[str] | None = None) -> DataFrame:
    """L3/L5/L6 on a snapshot: the next version, with ``columns`` updated by
    ``keys``.  ``bucket`` must be made of the keys, as for ``create_snapshot``.

    Returns one row per bucket: ``bucket``, ``version`` that holds it and
    whether this update wrote it.  An update for a key that the ledger does
    not have changes nothing.
    """
    last = versions(spark, path)[-1]
    touched = updates.select(bucket.cast("int").alias("bucket")).distinct()
    before = _manifest(spark, path, last)
    hit = [r.bucket for r in before.join(touched, "bucket", "left_semi").collect()]
    new = last + 1
    if hit:
        rows = apply_updates(read_snapshot(spark, path, last, hit), updates, keys, columns, order_cols).drop("updated")
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data-{new}")
    after = before.select("bucket", F.when(F.col("bucket").isin(hit), new).otherwise(F.col("version")).cast("int").alias("version"))
    after.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{new}")
    return _manifest(spark, path, new).withColumn("written", F.col("version") == new)
