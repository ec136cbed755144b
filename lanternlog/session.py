"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable options: instants are compared with an oracle in UTC, the adaptive
# planner does the join switching and skew splitting the operators count on, and a batch
# handed to Python is bounded in bytes, so that long texts come a few at a time.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def build(app: str = "lanternlog", master: str | None = None, **conf: str) -> SparkSession:
    """New session. ``master`` and shuffle width are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return pin(builder.getOrCreate())


def pin(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the checkpoint folder set.

    Only a local master, as in tests, may do without; one temporary folder then serves the session
    and is removed when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="lanternlog-"))
    return _own[0].name


_own: list[tempfile.TemporaryDirectory] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written state, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


#: Bytes of input files whose rows one task works on. Packed files hold some fifty thousand small rows a megabyte.
SHARE = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """Share a scan out in tasks that grow in number, not in size, with its input.

    Every core gets a share of a small input. A scan has no more tasks than its files have row groups, and one split of
    packed columns may be millions of rows; where each row takes real work, ``SHARE`` bytes of files are a task's.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(cores, -(-size // SHARE))
    return df.repartition(tasks) if df._jdf.rdd().getNumPartitions() < tasks else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
