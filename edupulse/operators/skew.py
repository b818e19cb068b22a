"""Splitting of keys that hold too many rows for one task.

Order-dependent operators need every row of a key in order. For ordinary keys that is one
hash shuffle. A key above the row limit is cut into *segments*: contiguous, range-partitioned
runs of its rows, each a task of its own, joined up again through one small row per segment.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from edupulse.session import MAX_BROADCAST_ROWS, materialize, max_rows_per_group

SEGMENT = "_segment"
UNSPLIT = math.inf  # as max_rows: the caller knows that no key needs splitting


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def _hot_counts(df: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)


def group_limit(df: DataFrame, keys: Sequence[str], max_rows: float | None = None) -> float:
    """``UNSPLIT`` when no key of ``df`` is above the limit, else the limit.

    Pass the result as ``max_rows`` to operators on the same rows with these keys or finer ones,
    so that the counting is done once.
    """
    limit = max_rows or max_rows_per_group(df.sparkSession)
    if limit == UNSPLIT:
        return UNSPLIT
    # One aggregate row, so the check is a single job.
    return limit if _hot_counts(df, keys, limit).agg(F.count(F.lit(1))).first()[0] else UNSPLIT


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: float | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``(ordinary, hot)``: rows of keys within the limit, and segmented rows of the others.

    ``hot`` is None when no key is above the limit, which costs one pre-aggregated count over
    the key columns. ``order`` must be a total order within a key, or segments cannot be cut.
    """
    limit = max_rows or max_rows_per_group(df.sparkSession)
    if limit == UNSPLIT:
        return df, None
    prefix = "_hot_"
    counts = _hot_counts(df, keys, limit).select(*[F.col(k).alias(prefix + k) for k in keys], "_rows")
    found, total = counts.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if not found:
        return df, None
    if found <= MAX_BROADCAST_ROWS:
        hot_keys = F.broadcast(df.sparkSession.createDataFrame(counts.collect(), counts.schema))
    else:
        hot_keys = materialize(counts)
    condition = _same_key(df, hot_keys, keys, prefix)
    ordinary = df.join(hot_keys, condition, "left_anti")
    segments = max(math.ceil(total / limit), 2)
    hot = (
        df.join(hot_keys, condition, "left_semi")
        .repartitionByRange(segments, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(SEGMENT, F.spark_partition_id())
    )
    # Range bounds are sampled anew each time a plan runs, so the cut is fixed by writing it.
    return ordinary, materialize(hot)


def join_segment_values(hot: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per (key, segment) to the rows of that segment."""
    prefix = "_seg_"
    # At most one row per key and segment boundary: the hot rows over the limit, plus the number of hot keys.
    renamed = values.withColumnsRenamed({c: prefix + c for c in [*keys, SEGMENT]})
    condition = _same_key(hot, renamed, keys, prefix) & (hot[SEGMENT] == renamed[prefix + SEGMENT])
    return hot.join(renamed, condition).drop(*[prefix + c for c in [*keys, SEGMENT]])


def _context_rows(hot: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """For each (key, segment) the last ``n`` rows of the key that lie in earlier segments."""
    columns = hot.columns
    backwards = Window.partitionBy(*keys, SEGMENT).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        hot.withColumn("_back", F.row_number().over(backwards))
        .where(F.col("_back") <= n)
        .groupBy(*keys, SEGMENT)
        .agg(F.sort_array(F.collect_list(F.struct(F.expr("-_back").alias("_o"), *columns))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(-n, -1)
    joined = F.flatten(F.collect_list("_tail").over(earlier))
    carried = tails.select(SEGMENT, joined.alias("_all")).where(F.size("_all") > 0)
    last_n = F.slice("_all", F.greatest(F.size("_all") - n + 1, F.lit(1)), F.lit(n))
    return carried.select(SEGMENT, F.explode(last_n).alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in columns if c != SEGMENT], SEGMENT
    )


def lookback_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    max_rows: float | None = None,
) -> DataFrame:
    """Window columns that look at most ``n`` rows back within a key.

    ``add(frame, window)`` adds the columns. Segments of hot keys see the ``n`` rows before them.
    """
    ordinary, hot = split_hot(df, keys, order, max_rows)
    result = add(ordinary, Window.partitionBy(*keys).orderBy(*order))
    if hot is None:
        return result
    rows = hot.withColumn("_context", F.lit(False)).unionByName(
        _context_rows(hot, keys, order, n).withColumn("_context", F.lit(True))
    )
    segmented = add(rows, Window.partitionBy(*keys, SEGMENT).orderBy(*order))
    return result.unionByName(segmented.where(~F.col("_context")).drop("_context", SEGMENT))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    max_rows: float | None = None,
) -> DataFrame:
    """Adds, per key, the sum of each expression over all *earlier* rows (0 at the first row)."""
    ordinary, hot = split_hot(df, keys, order, max_rows)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    result = ordinary.withColumns(
        {name: F.coalesce(F.sum(value).over(before), F.lit(0)) for name, value in totals.items()}
    )
    if hot is None:
        return result
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        hot.groupBy(*keys, SEGMENT)
        .agg(*[F.sum(value).alias(name) for name, value in totals.items()])
        .select(*keys, SEGMENT, *[
            F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias("_carry_" + name) for name in totals
        ])
    )
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    segmented = join_segment_values(
        hot.withColumns({name: F.coalesce(F.sum(value).over(inside), F.lit(0)) for name, value in totals.items()}),
        carry, keys,
    )
    segmented = segmented.withColumns({name: F.col(name) + F.col("_carry_" + name) for name in totals})
    return result.unionByName(segmented.select(*result.columns))
