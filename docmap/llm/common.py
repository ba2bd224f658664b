"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmap.session import ensure_checkpoint_dir, ensure_worker_code

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given data folder, read whole."""
    ensure_checkpoint_dir(spark)
    ensure_worker_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` also changes other letters).

    For an all-ASCII text ``lower`` does exactly that and is much cheaper
    than the per-character ``translate``.
    """
    is_ascii = F.octet_length(c) == F.char_length(c)
    return F.when(is_ascii, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


_RUN = uuid.uuid4().hex[:12]
_FOLDERS: dict[str, SparkSession] = {}


# Spark removes the shuffle files of a query with this setting when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, release_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and reread it.

    With ``release_shuffles`` the shuffle files of the write are removed on all
    executors as soon as it is done (the plan of ``df`` is not used again).

    This cuts the lineage: later jobs, and tasks rerun after an executor was
    lost, read the written files instead of recomputing ``df``.  The folder
    is shared by driver and executors; ``release`` or the end of the driver
    process removes it.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{_RUN}"
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if base not in _FOLDERS:
        _FOLDERS[base] = spark
        atexit.register(release, spark)
    if release_shuffles:
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    else:
        df.write.parquet(path)
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any
    more: that happens when the driver collects its garbage, which it would
    not do for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Remove every table that ``stored`` wrote in this process."""
    for base, owner in list(_FOLDERS.items()):
        if owner is not spark:
            continue
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(base)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
        _FOLDERS.pop(base, None)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in pieces of at most ``rows`` rows, so that the Python
    copies of long texts stay few at a time.  The many small lists and strings
    made from them hold no cycles, so cyclic garbage collection is off until the
    last batch is done."""
    before = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
    finally:
        if before:
            gc.enable()


def least_hashed(rows: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each group, those with the least hashes of
    their (distinct) keys, with ``_rank`` and the group's ``_size``.

    Only rows with a hash in the least ``2 * limit / _size`` of the range are
    ranked, so that no task gets more of a large group than about twice the
    limit; if that left too few of a group, all rows are ranked.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    sized = rows.join(sizes, group).withColumn("_hash", F.xxhash64(key))
    place = F.col("_hash").cast("double") / float(2 ** 64) + 0.5
    order = Window.partitionBy(group).orderBy("_hash", key)

    def ranked(some: DataFrame) -> DataFrame:
        return some.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_hash")

    few = ranked(sized.filter(place <= F.lit(2.0 * limit) / F.col("_size")))
    due = sizes.agg(F.sum(F.least("_size", F.lit(limit)))).first()[0] or 0
    return few if few.count() == due else ranked(sized)


def gram_buckets(words: list[str], buckets: int, sizes: tuple[int, ...] = (2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of the hashed character n-grams of each word
    with its borders, and of each word as a whole."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    c = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[word] - np.arange(len(c))  # characters from here to the word's end
    found = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) % np.uint64(buckets)]
    of, h = [np.arange(len(words))], c
    for k in range(2, max(sizes) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + c[k - 1:]
        if k not in sizes:
            continue
        inside = left[:len(h)] >= k
        mixed = (h[inside] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(32)) % np.uint64(buckets))
        of.append(word[:len(h)][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


_STATE: dict[tuple, object] = {}


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task (word caches), made once
    for each key.  Only the last key is kept: the next operator that runs in
    the worker frees the memory of the one before."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]
