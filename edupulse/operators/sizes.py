"""Broadcast hints and task sizes backed by a measured row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.session import MAX_BROADCAST_ROWS

# Rows that one task of a large join or aggregate takes.
TASK_ROWS = 250_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` as a broadcast table when it has few rows, else unchanged for Spark to plan.

    Meant for reduced tables (one row per skill, label, course): at most
    ``MAX_BROADCAST_ROWS`` + 1 rows are fetched to find out.
    """
    rows = df.limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) > MAX_BROADCAST_ROWS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def in_even_tasks(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df``, of about so many rows, dealt by ``keys`` to tasks that grow in number and not in size.

    Spark sizes tasks by their compressed shuffle bytes, of which a sort or a hash table may take thirty times as much
    memory. For keys of bounded groups.
    """
    return df.repartition(-(-rows // TASK_ROWS), *keys) if rows > TASK_ROWS else df
