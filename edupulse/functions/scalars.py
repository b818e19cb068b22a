"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: day offsets of course tables count from this instant (UTC).
DAY_ZERO = "2020-01-01 00:00:00"


def day_to_timestamp(day: Column) -> Column:
    """Course-relative day offset (may be negative) as a timestamp."""
    return F.timestamp_add("DAY", day.cast("int"), F.lit(DAY_ZERO).cast("timestamp"))


def day_of_week(date: Column) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(date) - 1


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL when the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def with_percent(band: Column) -> Column:
    """Band text with its trailing percent sign; NULL stays NULL."""
    return F.when(~band.endswith("%"), F.concat(band, F.lit("%"))).otherwise(band)


def bucket_of(key: Column, seed: int | str) -> Column:
    """Repeatable bucket 0..9999 of a key: first 32 bits of md5('seed:key') mod 10,000."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000).cast("int")


def two_decimals(value: Column) -> Column:
    """Text of a value in [0, 1] with two decimals, rounding the exact binary value.

    ``format_string`` rounds the shortest decimal text half up, which differs at midpoints such
    as 0.625; there are only 100 midpoints, so their outcomes are listed.
    """
    midpoints = [(i + 0.5) / 100 for i in range(101)]
    outcomes = F.array(*[F.lit(round(float(f"{m:.2f}") * 100)) for m in midpoints])
    index = F.least(F.floor(value * 100), F.lit(100)).cast("int")
    midpoint = (index + 0.5) / 100
    cents = (
        F.when(value > midpoint, index + 1)
        .when(value < midpoint, index)
        .otherwise(F.element_at(outcomes, index + 1))
    )
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
