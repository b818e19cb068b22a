"""Repeatable splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.functions.scalars import bucket_of
from edupulse.operators.ordinal import global_ordinal
from edupulse.operators.sizes import broadcast_if_small


def split_by_key(df: DataFrame, *, key: str, fractions: dict[str, float], seed: int = 42, name: str = "split") -> DataFrame:
    """A split label from a hash of the key, so all rows of a key share it on any cluster."""
    bucket, label, edge = bucket_of(F.col(key), seed), None, 0.0
    names = list(fractions)
    for part in names[:-1]:
        edge += fractions[part]
        test = bucket < round(edge * 10_000)
        label = F.when(test, part) if label is None else label.when(test, part)
    return df.withColumn(name, F.lit(names[-1]) if label is None else label.otherwise(names[-1]))


# Student-level shares of the tracing experiment and of the parameter fit.
EXPERIMENT_FRACTIONS = {"train_fit": 0.64, "val": 0.16, "test": 0.20}
FIT_FRACTIONS = {"train": 0.8, "test": 0.2}


def stratified_split(
    df: DataFrame, *, label: str, key: str | Sequence[str], val: float = 0.2, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """M1: adds ``split`` = train / val / test with the same shares inside every label.

    Rows are ordered by label and key hash with the global ordinal; labels are then intervals.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_hash", bucket_of(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), seed))
    placed = global_ordinal(hashed, order_by=[label, "_hash", *keys], name="_ord")
    strata = placed.groupBy(F.col(label).alias("_label")).agg(
        F.min("_ord").alias("_start"), F.count(F.lit(1)).alias("_n"))
    joined = placed.join(broadcast_if_small(strata), placed[label].eqNullSafe(F.col("_label")))
    at = F.col("_ord") - F.col("_start")
    train_end = F.floor(F.round(F.col("_n") * (1 - val - test), 6))
    val_end = F.floor(F.round(F.col("_n") * (1 - test), 6))
    split = F.when(at < train_end, "train").when(at < val_end, "val").otherwise("test")
    return joined.withColumn("split", split).select(*df.columns, "split")


def chronological_split(df: DataFrame, *, order_by: Sequence[str], test: float = 0.2) -> DataFrame:
    """M4: adds ``split``: the first ``int(n * (1 - test))`` rows in time order are train."""
    placed = global_ordinal(df, order_by=order_by, name="_ord")
    cut = int(placed.count() * (1 - test))
    return placed.withColumn("split", F.when(F.col("_ord") < cut, "train").otherwise("test")).drop("_ord")
