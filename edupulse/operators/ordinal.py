"""A global row number without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edupulse.session import MAX_BROADCAST_ROWS, materialize

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row position in the low 33 bits


def global_ordinal(df: DataFrame, *, order_by: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Adds ``name`` = 0, 1, 2, … in ``order_by`` order, which must be a total order.

    Rows are range-partitioned and sorted, so a partition's rows are consecutive; the only thing
    gathered is one count per partition.
    """
    spark = df.sparkSession
    placed = materialize(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, rows in counts:
        offsets.append((part, total))
        total += rows
    table = spark.createDataFrame(offsets, "_part int, _offset long")
    if len(offsets) <= MAX_BROADCAST_ROWS:
        table = F.broadcast(table)
    return (
        placed.join(table, "_part")
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_part", "_at", "_offset")
    )


def with_surrogate_key(df: DataFrame, order_cols: Sequence[str], name: str = "id") -> DataFrame:
    """Surrogate key 1..n in the order of ``order_cols``.

    Ties go by a hash of the whole row, so a retried load gives every row the same key. Rows equal in all columns
    are interchangeable; a counter spreads many of them over several range partitions. It is taken after a
    local sort, so a recomputed task gives the same counters to the same rows. The only write is that of
    ``global_ordinal``.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns)).sortWithinPartitions(*order_cols, "_hash")
    numbered = global_ordinal(
        hashed.withColumn("_tie", F.monotonically_increasing_id()), order_by=[*order_cols, "_hash", "_tie"], name=name)
    return numbered.withColumn(name, F.col(name) + 1).drop("_hash", "_tie")


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column (NULLs skipped; the mean of two middle values when even).

    Values are reduced to (column, value, count), range-partitioned, and counted per partition;
    the driver sees one count per partition and column and the middle values themselves.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_p")
    placed = materialize(
        df.select(pairs).select("_p.*").where(F.col("v").isNotNull())
        .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange("c", "v").withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part", "c").orderBy("v")
    ranked = placed.withColumn("_upto", F.sum("n").over(upto))
    totals: dict[str, list[tuple[int, int]]] = {}
    for row in placed.groupBy("c", "_part").agg(F.sum("n").alias("n")).collect():
        totals.setdefault(row["c"], []).append((row["_part"], row["n"]))

    wanted = F.lit(False)
    for column, parts in totals.items():
        total, offset = sum(n for _, n in parts), 0
        for part, n in sorted(parts):
            for rank in {(total - 1) // 2, total // 2}:
                if offset <= rank < offset + n:
                    at = rank - offset
                    wanted = wanted | (
                        (F.col("c") == column) & (F.col("_part") == part)
                        & (F.col("_upto") > at) & (F.col("_upto") - F.col("n") <= at))
            offset += n
    middle: dict[str, list[float]] = {}
    for row in ranked.where(wanted).collect():
        middle.setdefault(row["c"], []).append(row["v"])
    return {c: sum(v) / len(v) if (v := middle.get(c)) else 0.0 for c in columns}
