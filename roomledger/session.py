"""Session defaults and the shared folder for cutting lineage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings a job needs for right results, plus adaptive execution, which is
# what splits skewed joins and merges small shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording the Python call site of every column expression costs more than
    # planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "roomledger",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, set on first use when it is unset.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master, where driver and executors are one process, may fall back to a
    temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="roomledger-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path next to the checkpoints, visible to every executor."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def once(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, stored while the block runs: its passes share the joins behind them."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


ROWS_PER_PARTITION = 50_000


def training_rows(df: DataFrame) -> DataFrame:
    """Rows for an iterative fit: lineage cut, small partitions merged, stored.

    An iteration is one job over these rows, so a short lineage and no needless tasks
    matter more than anything else on small data; on large data nothing is merged.
    """
    checkpoint_dir(df.sparkSession)
    cut = df.checkpoint().persist(StorageLevel.MEMORY_AND_DISK)
    # The count stores the rows, so that on large data the checkpoint is read once.
    wanted = max(1, math.ceil(cut.count() / ROWS_PER_PARTITION))
    if cut.rdd.getNumPartitions() <= wanted:
        return cut
    cut.unpersist()
    return cut.coalesce(wanted).persist(StorageLevel.MEMORY_AND_DISK)
