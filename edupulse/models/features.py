"""Feature sets and preprocessing of the risk models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.operators.ordinal import exact_medians
from edupulse.operators.snapshots import ABSENCE_CATEGORIES, ABSENCE_COUNTS

MISSING_CATEGORY = "Unknown"


@dataclass(frozen=True)
class FeatureSet:
    """Inputs and target of a model; identifiers are not features."""

    target: str
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numeric]


# The published feature lists.
_COURSE_CATEGORIES = ["gender", "highest_education", "imd_band", "age_band", "disability",
                      "code_module", "code_presentation"]
_COURSE_NUMBERS = ["num_of_prev_attempts", "studied_credits", "date_registration",
                   "assessments_submitted_count", "assessments_mean_score", "assessments_due_count",
                   "assessments_submission_rate", "vle_total_clicks", "vle_active_days",
                   "vle_distinct_sites", "vle_days_since_last_click"]
DROPOUT = FeatureSet("is_dropout", _COURSE_CATEGORIES, _COURSE_NUMBERS, ["id_student"])
PERFORMANCE = FeatureSet("is_pass", _COURSE_CATEGORIES, _COURSE_NUMBERS, ["id_student"])
ATTENDANCE = FeatureSet(
    "is_high_absence_day", ["school_year", "day_of_week", "month"],
    ["absence_rate_lag1", "absence_rate_rolling_mean", "absence_rate_rolling_std"],
    ["school_id", "attendance_date"])
OCCUPANCY = FeatureSet("occupancy", [], ["temperature_c", "humidity_pct", "co2_ppm", "light_lux"],
                       ["source_file", "recorded_at"])
ABSENCE = FeatureSet("is_high_absence_risk", ABSENCE_CATEGORIES, ABSENCE_COUNTS, ["record_id"])


def fit_preprocess(train: DataFrame, *, categorical: Sequence[str], numeric: Sequence[str]) -> PipelineModel:
    """M2: learned from the training rows only.

    Missing categories become a category of their own; categories unseen in training encode as
    zeros. Numbers are filled with the training median, then standardised (population deviation).
    """
    medians = exact_medians(train, numeric) if numeric else {}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in numeric}
    stats = train.agg(
        *[F.avg(filled[c]).alias(f"mean_{c}") for c in numeric],
        *[F.stddev_pop(filled[c]).alias(f"std_{c}") for c in numeric],
    ).first() if numeric else None
    columns = [f"coalesce(cast(`{c}` AS string), '{MISSING_CATEGORY}') AS `_c_{c}`" for c in categorical]
    for c in numeric:
        scale = stats[f"std_{c}"] or 1.0
        columns.append(
            f"(coalesce(cast(`{c}` AS double), {medians[c]!r}D) - {stats[f'mean_{c}']!r}D) / {scale!r}D AS `_n_{c}`")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    if categorical:
        stages += [
            StringIndexer(inputCols=[f"_c_{c}" for c in categorical], outputCols=[f"_i_{c}" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical],
                          dropLast=True),
        ]
    stages.append(VectorAssembler(
        inputCols=[*[f"_o_{c}" for c in categorical], *[f"_n_{c}" for c in numeric]], outputCol="features"))
    return Pipeline(stages=stages).fit(train)
