"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every docmap job relies on.  AQE re-plans joins from runtime
# sizes (automatic broadcast only below the measured threshold) and splits
# skewed shuffle partitions; the time zone makes date text stable.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "docmap") -> SparkSession:
    """Return the active session, or build one with docmap's settings.

    On a cluster the session already exists (spark-submit); locally a
    ``local[N]`` master is used.  ``spark.checkpoint.dir`` is only set when
    the session does not name one (tests); on a cluster it must point to
    the shared folder the cluster provides.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        ensure_worker_code(active)
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_worker_code(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder from the session; a private temp folder only if it is
    unset and driver and executors are one process (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="docmap-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_RUN = uuid.uuid4().hex[:12]
_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder; what is written
    there is removed by ``remove_scratch`` or when the driver ends."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docmap-{_RUN}"
    if base not in _SCRATCH:
        _SCRATCH[base] = spark
        atexit.register(remove_scratch, spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in scratch and read again: later jobs and
    repeated tasks read files instead of computing it anew, with ``by`` only
    those of the wanted values of these columns."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Remove everything below ``scratch_path`` of this process."""
    for base, owner in list(_SCRATCH.items()):
        if owner is spark:
            try:
                p = spark._jvm.org.apache.hadoop.fs.Path(base)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # noqa: BLE001  the session may be gone already
                pass
            _SCRATCH.pop(base, None)


_SHIPPED: set[str] = set()


def ensure_worker_code(spark: SparkSession) -> None:
    """Make ``docmap`` importable in Python workers (once per SparkContext).

    UDF bodies import docmap helpers; on a cluster (or when the driver runs
    outside the repository) workers only see code shipped with the job, so
    the package is zipped and added with ``addPyFile``.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="docmap-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "docmap"), "zip", os.path.dirname(pkg), "docmap")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def plan_size_bytes(df) -> int:
    """Catalyst's size estimate of a DataFrame's plan (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df, bytes_per_partition: int = 128 * 1024 * 1024, expansion: int = 1) -> int:
    """Partition count for an explicit repartition: one per ``bytes_per_partition``
    of (expanded) input, and at least two per core; when the plan has no size
    estimate, ``spark.sql.shuffle.partitions``."""
    spark = df.sparkSession
    size = plan_size_bytes(df)
    if size >= 2 ** 62:  # no statistics (e.g. after a Python stage): use the session setting
        return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
                   2 * spark.sparkContext.defaultParallelism)
    by_size = -(-size * expansion // bytes_per_partition)
    return max(int(by_size), 2 * spark.sparkContext.defaultParallelism)
