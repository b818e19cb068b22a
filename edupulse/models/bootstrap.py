"""Student-level bootstrap of a log-loss difference."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edupulse.operators.metrics import LOG_CLIP


def _loss(label, prob):
    p = F.least(F.lit(1.0 - LOG_CLIP), F.greatest(F.lit(LOG_CLIP), prob))
    return -F.when(label, F.log(p)).otherwise(F.log(1.0 - p))


# A weight is the number of bounds that a hash of (student, replicate) reaches: the cumulative Poisson(1)
# probabilities, in parts of the hash's range. Squares modulo a prime mix the two, in numbers below 2**62.
PRIME = 2**31 - 1
MULTIPLIERS = (48_271, 1_103_515_245)
ROUNDS = (12_345, 1_013_904_223, 715_827_883)
BOUNDS = [math.floor(PRIME * sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def draw(student: Column, replicate: Column, seed: int) -> Column:
    """Hash of a student (a whole number) and a replicate; the same wherever it is computed."""
    by_student, by_replicate = MULTIPLIERS
    x = (F.pmod(student, F.lit(PRIME)) * by_student + replicate * by_replicate + seed % PRIME) % PRIME
    for add in ROUNDS:
        x = (x * x + add) % PRIME
    return x


def poisson_weight(drawn: Column) -> Column:
    """Poisson(1) weight of a drawn hash."""
    return functools.reduce(lambda a, b: a + b, [(drawn >= bound).cast("int") for bound in BOUNDS])


def bootstrap_diff(
    df: DataFrame, *, reference: str = "reference", challenger: str = "challenger", label: str = "correct",
    student: str = "student_id", n: int = 2000, seed: int = 42,
) -> DataFrame:
    """One row (point, low, high): challenger minus reference log loss, 95 % percentile interval.

    Both predictions are columns of one frame, so rows cannot be misaligned. A NULL prediction is
    an error rather than a dropped row. Students are the unit that is resampled.
    """
    if df.where(F.col(reference).isNull() | F.col(challenger).isNull()).limit(1).count():
        raise ValueError("every row needs both predictions")
    diff = _loss(F.col(label).cast("boolean"), F.col(challenger)) - _loss(F.col(label).cast("boolean"), F.col(reference))
    students = df.groupBy(F.col(student).alias("student_id")).agg(F.sum(diff).alias("diff"), F.count(F.lit(1)).alias("n"))
    whole = isinstance(df.schema[student].dataType, T.IntegralType)
    number = F.coalesce(F.col("student_id").cast("long") if whole else F.crc32(F.col("student_id").cast("string")), F.lit(-1))
    drawn = draw(F.col("number"), F.col("replicate"), seed)
    # A student meets the replicates one after the other; the sums combine before the shuffle.
    replicates = (
        students.select("diff", "n", number.alias("number"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("replicate"))
        .select("replicate", "diff", "n", drawn.alias("drawn"))
        .select("replicate", "diff", "n", poisson_weight(F.col("drawn")).alias("weight"))
        .groupBy("replicate").agg(F.sum(F.col("weight") * F.col("diff")).alias("diff"), F.sum(F.col("weight") * F.col("n")).alias("n"))
        .select(F.try_divide("diff", "n").alias("d"))
    )
    # n values, sorted; the point estimate is a one-row aggregate.
    interval = replicates.agg(F.sort_array(F.collect_list("d")).alias("d")).select(
        F.get("d", F.floor(F.size("d") * 0.025).cast("int")).alias("low"),
        F.get("d", F.least(F.size("d") - 1, F.floor(F.size("d") * 0.975).cast("int"))).alias("high")).first()
    return students.agg(F.try_divide(F.sum("diff"), F.sum("n")).alias("point")).select(
        "point", F.lit(interval["low"]).alias("low"), F.lit(interval["high"]).alias("high"))
