"""Table sinks and keyed state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.operators.quality import check_unique, enforce


def write_table(
    df: DataFrame, path: str, *, mode: str = "errorifexists", partition_by: Sequence[str] = (),
    key: Sequence[str] = (), table: str = "table",
) -> None:
    """Parquet table; a declared key is checked first, so a colliding load fails whole."""
    if key:
        enforce([check_unique(df, list(key), table=table)])
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_latest(base: DataFrame, updates: DataFrame, *, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows of both, the last version of each key; keys absent from ``updates`` stay.

    ``max_by`` combines map-side, so a key with many versions is one row per task after the scan.
    Between equal versions the update wins. A NULL in the winning row replaces an old value.
    """
    rest = [c for c in base.columns if c not in keys]
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.select(*base.columns).withColumn("_new", F.lit(1)))
    winner = F.max_by(F.struct(*rest), F.struct(*order_by, "_new")).alias("_row")
    return both.groupBy(*keys).agg(winner).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in base.columns])


def delete_keys(base: DataFrame, keys_df: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys_df`` (NULL matches NULL)."""
    gone = keys_df.select(*[F.col(k).alias("_gone_" + k) for k in keys]).distinct()
    match = reduce(lambda a, b: a & b, [base[k].eqNullSafe(gone["_gone_" + k]) for k in keys])
    return base.join(gone, match, "left_anti")
