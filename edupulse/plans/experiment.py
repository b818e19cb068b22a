"""The knowledge-tracing experiment: splits, fits, selections, test scores and intervals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.models.bootstrap import bootstrap_diff
from edupulse.models.calibrate import ITERATION_CANDIDATES, Selection, select_bkt
from edupulse.models.classifiers import C_CANDIDATES, GBT_CANDIDATES, score, select_gbt, select_lr
from edupulse.operators.aggregates import prediction_counts, skill_difficulty
from edupulse.operators.metrics import evaluate_predictions
from edupulse.operators.splits import EXPERIMENT_FRACTIONS, split_by_key
from edupulse.operators.windows import kt_features, kt_vector
from edupulse.session import materialize


@dataclass
class TracingExperiment:
    """Lazily evaluated parts over one attempt table.

    Students are split once. Skill difficulty comes from train-fit students only, for all rows;
    the tracing parameters behind the features are refitted on train-fit and validation.
    """

    attempts: DataFrame
    iterations: Sequence[int] = ITERATION_CANDIDATES
    c_candidates: Sequence[float] = C_CANDIDATES
    gbt_candidates: Sequence[dict] = GBT_CANDIDATES
    seed: int = 42

    @cached_property
    def _split(self) -> DataFrame:
        return split_by_key(self.attempts, key="student_id", fractions=EXPERIMENT_FRACTIONS, seed=self.seed)

    def part(self, *names: str) -> DataFrame:
        return self._split.where(F.col("split").isin(*names)).drop("split")

    @cached_property
    def tracing(self) -> Selection:
        return select_bkt(self.part("train_fit"), self.part("val"), candidates=self.iterations)

    @cached_property
    def features(self) -> DataFrame:
        """Feature rows of all students, written once: every model reads them."""
        difficulty = skill_difficulty(self.part("train_fit"))
        rows = kt_features(self.attempts, difficulty=difficulty, params=self.tracing.params)
        return materialize(split_by_key(rows, key="student_id", fractions=EXPERIMENT_FRACTIONS, seed=self.seed))

    def _rows(self, *names: str) -> DataFrame:
        return self.features.where(F.col("split").isin(*names))

    @cached_property
    def logistic(self):
        return select_lr(self._rows("train_fit"), self._rows("val"), self._rows("train_fit", "val"),
                         candidates=self.c_candidates)

    @cached_property
    def boosted(self):
        return select_gbt(self._rows("train_fit"), self._rows("val"), self._rows("train_fit", "val"),
                          candidates=self.gbt_candidates, seed=self.seed)

    def predictions(self, *, boosted: bool = True) -> DataFrame:
        """Test rows with one probability column per model."""
        rows = self._rows("test").withColumn("bkt", self.tracing.params.predict(F.col("bkt_mastery_before")))
        models = {"lr": self.logistic[0]} | ({"gbt": self.boosted[0]} if boosted else {})
        rows = kt_vector(rows, policy="linear")
        for name, model in models.items():
            rows = score(model, rows, prob=name, pred=f"{name}_class").drop(f"{name}_class")
        return rows.drop("features", "label")

    def report(self, *, boosted: bool = True) -> DataFrame:
        """One row per model: the test metrics, at row level for all of them."""
        rows = materialize(self.predictions(boosted=boosted))
        counts = prediction_counts(rows).first()
        parts = [
            evaluate_predictions(rows, label="correct", prob=name).withColumn("model", F.lit(name))
            for name in (["bkt", "lr", "gbt"] if boosted else ["bkt", "lr"])]
        return reduce(DataFrame.unionByName, parts).withColumns({
            "n_students": F.lit(counts["n_students"]), "n_skills": F.lit(counts["n_skills"])})

    def interval(self, challenger: str = "lr", *, n: int = 2000) -> DataFrame:
        """Bootstrap interval of a challenger's log loss minus the tracing model's."""
        rows = self.predictions(boosted=challenger == "gbt")
        return bootstrap_diff(rows, reference="bkt", challenger=challenger, n=n, seed=self.seed)
