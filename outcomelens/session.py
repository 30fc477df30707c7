"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "outcomelens",
                  shuffle_partitions: int | None = None, checkpoint_dir: str | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Session tuned for the engine: AQE on, UI off, UTC, Arrow on.

    The master and the memory settings are the submit command's; ``master`` and
    ``driver_memory`` are set only when given (tests, the bench).
    """
    master = master or os.environ.get("OUTCOMELENS_MASTER")
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.showConsoleProgress", "false")
         # checkpoint files go when the frames that need them do
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        b = b.master(master)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The folder is the shared one named by ``spark.checkpoint.dir``.  Where that
    is unset, a folder inside the SQL warehouse is taken, which executors share
    too; no machine-local temporary folder is ever used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings while the block runs; those before come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Shuffle files go as soon as the write that made them has ended, not when the driver's memory is next cleaned.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
