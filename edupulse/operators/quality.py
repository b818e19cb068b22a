"""Data-quality checks.

A check returns one row ``(check, table, n_bad, n_rows)``. ``enforce`` runs checks and raises on
the first with bad rows; ``report`` runs them all and returns the rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A table breaks an invariant that must hold."""


def _row(df: DataFrame, check: str, table: str, n_bad: Column, n_rows: Column) -> DataFrame:
    return df.agg(
        F.coalesce(n_bad, F.lit(0)).cast("long").alias("n_bad"),
        F.coalesce(n_rows, F.lit(0)).cast("long").alias("n_rows"),
    ).select(F.lit(check).alias("check"), F.lit(table).alias("table"), "n_bad", "n_rows")


def _groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _repeated(df: DataFrame, keys: Sequence[str], check: str, table: str) -> DataFrame:
    repeated = F.sum(F.when(F.col("_n") > 1, F.col("_n")))
    return _row(_groups(df, keys), check, table, repeated, F.sum("_n"))


def check_unique(df: DataFrame, keys: Sequence[str], *, table: str) -> DataFrame:
    """Rows in key groups of more than one row (all of them)."""
    return _repeated(df, keys, "unique", table)


def check_duplicates(df: DataFrame, *, table: str) -> DataFrame:
    """Rows that equal another row in every column."""
    return _repeated(df, df.columns, "duplicates", table)


def check_row_count(before: DataFrame, after: DataFrame, *, table: str) -> DataFrame:
    """V2: rows gained or lost in a step meant to keep them."""
    sides = before.select(F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    return _row(sides, "row_count", table, F.abs(F.sum("_b") - F.sum("_a")), F.sum("_a"))


def _orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct child keys with row counts, flagged when absent from the parent. NULL equals NULL."""
    prefix = "_p_"
    parents = parent.select(*[F.col(k).alias(prefix + k) for k in keys]).distinct().withColumn("_found", F.lit(True))
    children = _groups(child, keys)
    match = functools.reduce(
        lambda a, b: a & b, [children[k].eqNullSafe(parents[prefix + k]) for k in keys])
    return children.join(parents, match, "left").select("_n", F.col("_found").isNull().alias("_orphan"))


def check_foreign_key(child: DataFrame, parent: DataFrame, keys: Sequence[str], *, table: str) -> DataFrame:
    """V3: distinct child keys that the parent lacks (n_rows counts distinct child keys)."""
    return _row(
        _orphans(child, parent, keys), "foreign_key", table,
        F.sum(F.col("_orphan").cast("long")), F.count(F.lit(1)))


def check_foreign_key_rows(child: DataFrame, parent: DataFrame, keys: Sequence[str], *, table: str) -> DataFrame:
    """V4: child rows whose key the parent lacks, with ``n_bad_keys``."""
    return (
        _orphans(child, parent, keys)
        .agg(
            F.coalesce(F.sum(F.when(F.col("_orphan"), F.col("_n"))), F.lit(0)).alias("n_bad"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.col("_orphan").cast("long")), F.lit(0)).alias("n_bad_keys"),
        )
        .select(F.lit("foreign_key_rows").alias("check"), F.lit(table).alias("table"), "n_bad", "n_rows", "n_bad_keys")
    )


def outside_domain(column: str, allowed: Iterable[Any]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def outside_range(column: str, low: float | None, high: float | None) -> Column:
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < low)
    if high is not None:
        outside = outside | (F.col(column) > high)
    return F.coalesce(outside, F.lit(False))


def check_allowed(df: DataFrame, column: str, allowed: Iterable[Any], *, table: str) -> DataFrame:
    """V6: rows whose value is outside a finite domain; NULL is outside."""
    return _row(df, "allowed", table, F.sum(outside_domain(column, allowed).cast("long")), F.count(F.lit(1)))


def check_range(df: DataFrame, column: str, low: float | None, high: float | None, *, table: str) -> DataFrame:
    """V7: rows outside [low, high]; NULL is skipped, a bound of None is open."""
    return _row(df, "range", table, F.sum(outside_range(column, low, high).cast("long")), F.count(F.lit(1)))


def check_nulls(df: DataFrame, *, table: str) -> DataFrame:
    """V8: rows with a NULL in any column."""
    any_null = functools.reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in df.columns])
    return _row(df, "nulls", table, F.sum(any_null.cast("long")), F.count(F.lit(1)))


def check_columns(df: DataFrame, expected: Iterable[str], *, table: str) -> list[str]:
    """Raises when the column set differs, naming missing and unexpected columns."""
    missing, extra = set(expected) - set(df.columns), set(df.columns) - set(expected)
    if missing or extra:
        raise QualityError(f"{table}: missing {sorted(missing)}, unexpected {sorted(extra)}")
    return list(df.columns)


def require_columns(df: DataFrame, needed: Iterable[str], *, table: str) -> None:
    """Raises when a needed column is absent; others are ignored."""
    missing = set(needed) - set(df.columns)
    if missing:
        raise QualityError(f"{table}: missing {sorted(missing)}")


def check_identity(df: DataFrame, total: str, parts: Sequence[str], *, table: str) -> DataFrame:
    """Rows where ``total`` differs from the sum of ``parts``."""
    parts_sum = functools.reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return _row(df, "identity", table, F.sum((F.col(total) != parts_sum).cast("long")), F.count(F.lit(1)))


def unseen_values(df: DataFrame, column: str, known: Iterable[Any]) -> DataFrame:
    """Distinct values outside a known domain, one row each."""
    return df.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(*known)).distinct()


def check_two_hop(
    child: DataFrame, bridge: DataFrame, parent: DataFrame, *, bridge_key: str, parent_keys: Sequence[str], table: str
) -> DataFrame:
    """Child → bridge → parent composite key. Child keys without a bridge row are orphans too."""
    # Aggregated before the join, so a frequent child key crosses the shuffle once per task.
    needed = [k for k in parent_keys if k not in child.columns]
    child_keys = child.select(*dict.fromkeys([bridge_key, *[k for k in parent_keys if k in child.columns]])).distinct()
    via = child_keys.join(bridge.select(bridge_key, *needed), bridge_key, "left")
    return check_foreign_key(via, parent, parent_keys, table=table).withColumn("check", F.lit("two_hop"))


def check_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], *, table: str) -> DataFrame:
    """Key groups that are not exactly one row on each side."""
    tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sides = tagged.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    bad = (F.col("_l") != 1) | (F.col("_r") != 1)
    return _row(sides, "one_to_one", table, F.sum(bad.cast("long")), F.count(F.lit(1)))


def report(checks: Iterable[DataFrame]) -> list[Row]:
    """Results of non-fatal checks."""
    return [check.first() for check in checks]


def enforce(checks: Iterable[DataFrame]) -> list[Row]:
    """Raises on the first check with bad rows."""
    rows = []
    for check in checks:
        row = check.first()
        if row["n_bad"]:
            raise QualityError(f"{row['table']}: {row['check']} failed for {row['n_bad']} of {row['n_rows']}")
        rows.append(row)
    return rows
