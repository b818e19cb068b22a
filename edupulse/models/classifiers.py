"""Risk models and their use."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.base import Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.functions.scalars import bucket_of
from edupulse.models.features import FeatureSet, fit_preprocess
from edupulse.operators.metrics import evaluate_predictions
from edupulse.operators.quality import require_columns
from edupulse.operators.windows import kt_vector

# The published settings.
FOREST = {"trees": 300, "depth": 8, "min_leaf": 10, "seed": 42}
C_CANDIDATES = (0.01, 0.1, 1.0, 10.0)
GBT_CANDIDATES = (
    {"max_depth": 3, "learning_rate": 0.1, "max_iter": 100},
    {"max_depth": 3, "learning_rate": 0.05, "max_iter": 200},
    {"max_depth": 5, "learning_rate": 0.05, "max_iter": 200},
    {"max_depth": 5, "learning_rate": 0.1, "max_iter": 100},
)


def _labelled(df: DataFrame, features: FeatureSet) -> DataFrame:
    require_columns(df, [*features.features, features.target], table="snapshot")
    return df.withColumn("label", F.col(features.target).cast("double"))


def with_balanced_weights(df: DataFrame, *, label: str = "label", name: str = "weight") -> tuple[DataFrame, float]:
    """Weights n / (2 * n_class), and their total (which is n)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) != 2:
        raise ValueError(f"a binary label is needed, found {sorted(counts)}")
    total = sum(counts.values())
    weight = reduce(
        lambda acc, item: acc.when(F.col(label) == item[0], total / (2.0 * item[1])), counts.items(), F.when(F.lit(False), 0.0))
    return df.withColumn(name, weight), float(total)


def _fit(train: DataFrame, features: FeatureSet, make_classifier: Callable[[float], Any], balanced: bool) -> PipelineModel:
    # Counts, medians, moments, indexers and the learner each read the training rows.
    rows = _labelled(train, features).select(*features.features, "label").persist()
    try:
        weighted, total = (
            with_balanced_weights(rows) if balanced else (rows.withColumn("weight", F.lit(1.0)), float(rows.count())))
        prepare = fit_preprocess(rows, categorical=features.categorical, numeric=features.numeric)
        classifier = make_classifier(total).fit(prepare.transform(weighted).select("features", "label", "weight"))
    finally:
        rows.unpersist()
    return PipelineModel(stages=[prepare, classifier])


def fit_logistic(train: DataFrame, *, features: FeatureSet, c: float = 1.0, balanced: bool = True, max_iter: int = 1000) -> PipelineModel:
    """M3: preprocessing and L2 logistic regression; the penalty is scaled to the weight total."""
    return _fit(train, features, lambda total: LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=1e-6), balanced)


def fit_forest(
    train: DataFrame, *, features: FeatureSet, trees: int = FOREST["trees"], depth: int = FOREST["depth"],
    min_leaf: int = FOREST["min_leaf"], seed: int = FOREST["seed"], balanced: bool = True,
) -> PipelineModel:
    """M5: preprocessing and a class-balanced random forest.

    A row's node in every tree is kept from level to level, four bytes a tree, so that no level walks the trees from their roots.
    """
    return _fit(train, features, lambda _total: RandomForestClassifier(
        weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, cacheNodeIds=True), balanced)


def score(model: Transformer, df: DataFrame, *, prob: str = "prob", pred: str = "predicted_class") -> DataFrame:
    """M7: the input columns with probability and class at 0.5."""
    scored = model.transform(df)
    return scored.withColumn(prob, vector_to_array("probability")[1]).select(
        *df.columns, prob, (F.col(prob) >= 0.5).cast("int").alias(pred))


# Reasons a prediction is withheld.
MISSING, IN_SAMPLE = "missing", "in-sample"


def heldout_only(scored: DataFrame, *, split_col: str = "split", prob: str = "prob", pred: str = "predicted_class") -> DataFrame:
    """Predictions only for rows of the model's own test split, NULL with a reason otherwise."""
    held_out = F.col(split_col) == "test"
    reason = F.when(F.col(prob).isNull() | F.col(split_col).isNull(), MISSING).when(~held_out, IN_SAMPLE)
    return scored.withColumns({
        prob: F.when(held_out, F.col(prob)), pred: F.when(held_out, F.col(pred)), "withheld_reason": reason})


def serve_heldout(entities: DataFrame, scored: DataFrame, *, keys: Sequence[str], prob: str = "prob",
                  pred: str = "predicted_class", split_col: str = "split") -> DataFrame:
    """M14 for a list of entities: those without a snapshot row are 'missing'."""
    joined = entities.select(*keys).join(scored.select(*keys, prob, pred, split_col), list(keys), "left")
    return heldout_only(joined, split_col=split_col, prob=prob, pred=pred)


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Transformer], *, folds: int = 5, key: str, seed: int = 42) -> DataFrame:
    """Every row scored by a model that saw no row of its key; one model per hash fold."""
    placed = df.withColumn("fold", bucket_of(F.col(key), seed) % folds)
    parts = [score(fit(placed.where(F.col("fold") != f)), placed.where(F.col("fold") == f)) for f in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def _select(candidates: Sequence[Any], fit: Callable[[DataFrame, Any], Transformer], train: DataFrame,
            val: DataFrame, combined: DataFrame) -> tuple[Transformer, Any, list[float]]:
    losses = [
        evaluate_predictions(score(fit(train, c), val)).first()["log_loss"] for c in candidates]
    best = candidates[losses.index(min(losses))]
    return fit(combined, best), best, losses


def _cached_vectors(*frames: DataFrame) -> list[DataFrame]:
    return [kt_vector(f, policy="linear").select("student_id", "topic_id", "event_id", "correct", "features", "label").persist()
            for f in frames]


def select_lr(train_fit: DataFrame, val: DataFrame, combined: DataFrame, *, candidates: Sequence[float] = C_CANDIDATES):
    """L2 strength picked on validation log loss, refitted on both; (model, C, losses)."""
    def fit(rows: DataFrame, c: float) -> Transformer:
        return LogisticRegression(regParam=1.0 / (c * rows.count()), standardization=False, maxIter=2000, tol=1e-6).fit(rows)

    frames = _cached_vectors(train_fit, val, combined)
    try:
        return _select(candidates, fit, *frames)
    finally:
        for f in frames:
            f.unpersist()


def select_gbt(train_fit: DataFrame, val: DataFrame, combined: DataFrame, *,
               candidates: Sequence[dict[str, float]] = GBT_CANDIDATES, seed: int = 42):
    """Depth, rate and rounds picked on validation log loss, refitted on both.

    The tree learner takes no NaN: missing history is 0 beside its indicator column.
    """
    def fit(rows: DataFrame, c: dict[str, float]) -> Transformer:
        return GBTClassifier(maxDepth=int(c["max_depth"]), stepSize=c["learning_rate"], maxIter=int(c["max_iter"]),
                             seed=seed, maxBins=64).fit(rows)

    frames = _cached_vectors(train_fit, val, combined)
    try:
        return _select(candidates, fit, *frames)
    finally:
        for f in frames:
            f.unpersist()
