"""Session defaults and the few settings the library reads from a session.

``spark.checkpoint.dir``            shared folder for materialised intermediates (set by the cluster)
``spark.edupulse.maxRowsPerGroup``  rows of one key that one task may take; larger keys are split
"""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULT_MAX_ROWS_PER_GROUP = 1_000_000

# Tables handed to broadcast() hold at most this many rows of a few scalars (about 1 MB).
MAX_BROADCAST_ROWS = 10_000


def build_session(app_name: str = "edupulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def max_rows_per_group(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.edupulse.maxRowsPerGroup", str(DEFAULT_MAX_ROWS_PER_GROUP)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local session without any."""
    context = spark.sparkContext
    configured, current = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if current and (not configured or configured.rstrip("/") in current):
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package() -> None:
    """Sends this package's functions to Python workers by value, so that executors and streaming
    runners need no copy of it on their path."""
    cloudpickle.register_pickle_by_value(sys.modules["edupulse"])
