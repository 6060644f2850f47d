"""Session set-up and shared scratch space used by every module."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that cuts texts into tokens.
ROWS_PER_TASK = 2_000
#: Spark's setting to delete the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Applications whose scratch folder is deleted when this process ends.
_SCRATCH: set[str] = set()


def build_session(app: str = "ebbtide", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine relies on (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        # no Python call-site capture per expression: it dominates the time to build wide plans
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only for local masters that name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="ebbtide-")
    context.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path for written tables under the shared folder; deleted with the application's others at the end."""
    folder = f"{_checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


def _delete(jvm, configuration, folder: str) -> None:
    # a driver whose JVM is gone can delete nothing
    with contextlib.suppress(Py4JError, OSError):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    root = _checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: for results that several branches of a plan use.

    The planner knows the exact size of what was written, so it broadcasts a small table of its own accord and
    shuffles a large one. The write's shuffles are deleted as it ends: nothing reads them again, and left to the
    driver's garbage collection they fill the disks of a query that writes many tables.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by ``key``, in tasks of about ``ROWS_PER_TASK`` rows and at least one per slot.

    What a task makes of its texts (exploded tokens and their counts) is far larger than the texts, so the size of a
    task must not grow with the table, or it spills. The number is fixed: adaptive execution would size the tasks by the texts.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(slots, -(-df.count() // ROWS_PER_TASK)), key)


def spread(df: DataFrame, key: str, factor: int = 2) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the cluster has slots, or too many rows in each.

    A scan of many small splits passes through untouched.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= max(factor * slots, df.count() / ROWS_PER_TASK):
        return df
    return dealt(df, key)
