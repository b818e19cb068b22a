"""Streaming state as a table: append the changed rows, read the newest per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edupulse.operators.advance import advance_mastery
from edupulse.operators.mastery import CHAIN_KEYS, MasteryRule
from edupulse.operators.summaries import latest_rows
from edupulse.schemas import TABLES
from edupulse.session import ensure_checkpoint_dir

VERSION = "batch_id"


def append_changes(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order_by: Sequence[str]) -> None:
    """Writes a micro-batch's newest row per key to its own folder.

    A batch replayed after a failure overwrites the same folder, so the table stays exact.
    """
    latest_rows(batch, keys=keys, order_by=order_by).write.mode("overwrite").parquet(f"{path}/{VERSION}={batch_id}")


def upsert_sink(
    stream: DataFrame, path: str, *, keys: Sequence[str], order_by: Sequence[str], checkpoint: str,
    where: str | None = None, side_path: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the stream; rows matching ``where`` are upserted, the others go to ``side_path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.where(where) if where else batch
        if where and side_path:
            batch = batch.persist()
            kept = batch.where(where)
            batch.where(~F.coalesce(F.expr(where), F.lit(False))).write.mode("overwrite").parquet(
                f"{side_path}/{VERSION}={batch_id}")
        append_changes(kept, batch_id, path, keys, order_by)
        batch.unpersist()

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_upserted(spark: SparkSession, path: str, *, keys: Sequence[str]) -> DataFrame:
    """The current table: per key the row of the newest batch."""
    rows = spark.read.parquet(path)
    return latest_rows(rows, keys=keys, order_by=[VERSION]).drop(VERSION)


def compact(spark: SparkSession, path: str, new_path: str, *, keys: Sequence[str]) -> None:
    """Rewrites the current rows as one batch under a new path, for readers to switch to."""
    version = spark.read.parquet(path).agg(F.max(VERSION)).first()[0]
    read_upserted(spark, path, keys=keys).write.mode("errorifexists").parquet(f"{new_path}/{VERSION}={version}")


def advance_sink(
    attempt_stream: DataFrame, path: str, *, rule: MasteryRule, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """R1/R3 without per-key operator state: each micro-batch folds on from the stored states.

    A chain that fills a micro-batch is split into segments as in batch use. Attempts must arrive
    in order across micro-batches; order within one does not matter.
    """
    spark = attempt_stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        states = read_before(session, path, batch_id)
        advance_mastery(states, batch, rule).write.mode("overwrite").parquet(f"{path}/{VERSION}={batch_id}")

    def read_before(session: SparkSession, where: str, batch_id: int) -> DataFrame:
        hadoop = session._jvm.org.apache.hadoop.fs.Path(where)
        if not hadoop.getFileSystem(session._jsc.hadoopConfiguration()).exists(hadoop):
            return session.createDataFrame([], TABLES["student_knowledge_states"]).withColumn(
                "student_id", F.col("student_id").cast(attempt_stream.schema["student_id"].dataType))
        rows = session.read.parquet(where).where(F.col(VERSION) < batch_id)
        return latest_rows(rows, keys=CHAIN_KEYS, order_by=[VERSION]).drop(VERSION)

    ensure_checkpoint_dir(spark)
    writer = attempt_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
