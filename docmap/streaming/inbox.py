"""Incremental document inbox (S2, streaming form).

New ``*.xml`` files in a folder are landed into Bronze exactly once:
``readStream.text(wholetext)`` tracks processed files in the checkpoint,
``Trigger.AvailableNow`` drains what has arrived and stops.  Each
micro-batch runs the same batch landing function and is written to a folder of
its own number: a batch that is run again after a crash replaces its own rows
and adds none.  A file that arrives again under the same name with another
content is a new version of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmap.sources.bronze import land_documents

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPEN_COST = "spark.sql.files.openCostInBytes"


def inbox_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None, glob: str = "*.xml",
                 recursive: bool = False, path: Column | None = None, max_bytes_per_trigger: int = 16 << 30) -> DataFrame:
    """Files as they arrive, as Bronze rows.  ``path`` may give another path
    than the file's own (for example below the inbox), the id is made of it.

    A micro-batch is bounded by the bytes that its tasks read, so that many
    small files are one batch and not thousands, each with a plan, a commit and
    a rewritten file log; ``max_files_per_trigger`` bounds it by number instead."""
    limit = ("maxBytesPerTrigger", max_bytes_per_trigger) if max_files_per_trigger is None else ("maxFilesPerTrigger", max_files_per_trigger)
    raw = (spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
           .option(*limit).text(directory, wholetext=True))
    path = F.col("_metadata.file_path") if path is None else path
    docs = raw.select(path.alias("file_path"), F.col("value").alias("raw_xml"))
    docs = docs.withColumn("file_name", F.regexp_extract("file_path", r"([^/]+)$", 1))
    return land_documents(docs, uploaded_by="inbox")


def land_batch(docs: DataFrame, batch_id: int, bronze_path: str) -> None:
    """Write one micro-batch to its own folder, in place of what an earlier run
    of the same batch left there."""
    docs.write.mode("overwrite").parquet(f"{bronze_path}/batch_id={batch_id}")


def run_inbox(spark: SparkSession, directory: str, bronze_path: str, checkpoint: str, **stream_options):
    """Drain the inbox into a Parquet Bronze table; returns the finished query.

    The folders are listed by some tasks per core: Spark's own number is up to
    10,000 tasks a listing, most of them for one folder, and there are three
    listings in a drain.  A file counts as 64 KB to open and not as 4 MB, or a
    task would read, and write into a Parquet file of its own, 32 small files
    at most."""
    conf = {LISTING_TASKS: 8 * spark.sparkContext.defaultParallelism, OPEN_COST: 64 << 10}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        q = (inbox_stream(spark, directory, **stream_options).writeStream
             .foreachBatch(lambda docs, batch_id: land_batch(docs, batch_id, bronze_path))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return q


def file_versions(bronze: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Bronze rows with ``version`` (1, 2, .. of each file name, in the order
    of landing) and ``is_current``."""
    w = Window.partitionBy(name_col).orderBy("batch_id", "xml_id")  # the versions of one file
    last = F.max(F.struct("batch_id", "xml_id")).over(Window.partitionBy(name_col))
    return bronze.withColumns({"version": F.row_number().over(w), "is_current": F.struct("batch_id", "xml_id") == last})
