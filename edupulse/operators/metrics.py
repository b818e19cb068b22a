"""Scoring of (label, probability) frames.

Rows are first reduced to one row per distinct score. The scores are range-partitioned; each
partition contributes one summary row, and the exact AUC is put together from those.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edupulse.functions.scalars import ratio
from edupulse.operators.mastery import ATTEMPT_ORDER, CHAIN_KEYS
from edupulse.operators.windows import previous_outcome

LOG_CLIP = 1e-9


def _scorable(df: DataFrame, label: str, prob: str) -> DataFrame:
    """(p, y); a row that cannot be scored is an error, not a row less."""
    p, y = F.col(prob).cast("double"), F.col(label).cast("int")
    missing = p.isNull() | F.isnan(p) | y.isNull()
    refused = F.raise_error(F.lit(f"missing {prob} or {label}")).cast("double")
    return df.select(F.when(missing, refused).otherwise(p).alias("p"), y.alias("y"))


def _per_score(df: DataFrame, label: str, prob: str) -> DataFrame:
    return (
        _scorable(df, label, prob)
        .groupBy("p")
        .agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    )


def _summarise(scores: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One row: P, N, AUC, and the sum of each expression over the distinct scores."""
    placed = scores.repartitionByRange("p").withColumn("_part", F.spark_partition_id())
    below = Window.partitionBy("_part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    # A positive beats every negative below it, and half of those with the same score.
    wins = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2.0)
    parts = placed.withColumn("_wins", wins).groupBy("_part").agg(
        F.min("p").alias("p0"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum("_wins").alias("wins"), *[F.sum(e).alias(n) for n, e in sums.items()])
    # One element per partition of distinct scores.
    totals = parts.agg(
        F.sort_array(F.collect_list(F.struct("p0", "pos", "neg", "wins"))).alias("_parts"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
        *[F.sum(n).alias(n) for n in sums])
    start = F.struct(F.lit(0.0).alias("wins"), F.lit(0.0).alias("neg"))
    folded = F.aggregate("_parts", start, lambda acc, x: F.struct(
        (acc["wins"] + x["wins"] + x["pos"] * acc["neg"]).alias("wins"),
        (acc["neg"] + x["neg"]).alias("neg")))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return totals.withColumn("auc", F.try_divide(folded["wins"], pairs)).drop("_parts")


def evaluate_predictions(df: DataFrame, *, label: str = "label", prob: str = "prob") -> DataFrame:
    """n_predictions, log_loss, accuracy (at >= 0.5), brier_score, rmse, auc; one row.

    Only the log loss clips probabilities; AUC is NULL with a single class.
    """
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    clipped = F.least(F.lit(1.0 - LOG_CLIP), F.greatest(F.lit(LOG_CLIP), p))
    row = _summarise(_per_score(df, label, prob), {
        "_loss": -(pos * F.log(clipped) + neg * F.log(1.0 - clipped)),
        "_hits": F.when(p >= 0.5, pos).otherwise(neg),
        "_square": pos * (1.0 - p) * (1.0 - p) + neg * p * p,
    })
    n = F.col("positives") + F.col("negatives")
    brier = ratio(F.col("_square"), n)
    return row.select(
        n.alias("n_predictions"),
        ratio(F.col("_loss"), n).alias("log_loss"),
        ratio(F.col("_hits"), n).alias("accuracy"),
        brier.alias("brier_score"),
        F.sqrt(brier).alias("rmse"),
        "auc",
    )


evaluate_rowwise = evaluate_predictions


def constant_baseline(df: DataFrame, p: float, *, label: str = "correct") -> DataFrame:
    """K7: the same probability for every row, evaluated."""
    return evaluate_predictions(df.withColumn("prob", F.lit(float(p))), label=label)


def persistence_baseline(
    df: DataFrame, first: float = 0.5, *, label: str = "correct", max_rows: float | None = None
) -> DataFrame:
    """K8: predict the previous outcome of the same chain, evaluated."""
    rows = previous_outcome(
        df, key=CHAIN_KEYS, order=ATTEMPT_ORDER, value=label, first=first, name="prob", max_rows=max_rows)
    return evaluate_predictions(rows, label=label)


def _rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, tp + fn), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
    }


def classification_report(
    scored: DataFrame, *, threshold: float = 0.5, label: str = "label", prob: str = "prob"
) -> DataFrame:
    """M6: accuracy, precision, recall, F1, AUC and the four confusion counts at a threshold."""
    at = F.col("p") >= threshold
    row = _summarise(_per_score(scored, label, prob), {
        "tp": F.when(at, F.col("pos")).otherwise(0), "fp": F.when(at, F.col("neg")).otherwise(0)})
    row = row.withColumns({"fn": F.col("positives") - F.col("tp"), "tn": F.col("negatives") - F.col("fp")})
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return row.select(
        F.lit(threshold).alias("threshold"),
        *[e.alias(n) for n, e in _rates(tp, fp, tn, fn).items()],
        "auc", "positives", "negatives", "tp", "fp", "tn", "fn",
    )


def transition_report(scored: DataFrame, *, mask: str = "is_transition", **kwargs) -> DataFrame:
    """The report over all rows beside the report over transition rows only."""
    headline = classification_report(scored, **kwargs).withColumn("rows", F.lit("all"))
    changed = classification_report(scored.where(F.col(mask)), **kwargs).withColumn("rows", F.lit("transition"))
    return headline.unionByName(changed)


def threshold_grid(lo: float = 0.20, hi: float = 0.50, step: float = 0.01) -> list[float]:
    return [round(lo + step * i, 2) for i in range(round((hi - lo) / step) + 1)]


def threshold_sweep(
    scored_val: DataFrame, *, lo: float = 0.20, hi: float = 0.50, step: float = 0.01, tol: float = 0.10,
    baseline: float = 0.5, label: str = "label", prob: str = "prob",
) -> DataFrame:
    """M8: metrics per candidate threshold, with ``eligible`` and ``selected`` flags.

    Rows are counted once into the bins between thresholds; every threshold's counts are sums of
    bins. Eligible: better recall than at ``baseline`` with precision and F1 within ``tol``.
    """
    grid = threshold_grid(lo, hi, step)
    cuts = sorted({*grid, baseline})
    passed = functools.reduce(lambda a, b: a + b, [(F.col("p") >= t).cast("int") for t in cuts])
    hit = F.col("y").cast("long")
    bins = _scorable(scored_val, label, prob).groupBy(passed.alias("_bin")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    # From here on there is one row: at most len(cuts) + 1 bins.
    counts = bins.agg(
        F.collect_list(F.struct("_bin", "pos", "neg")).alias("_bins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))

    def above(i: Column, name: str) -> Column:
        over = F.filter("_bins", lambda b: b["_bin"] > i)
        return F.aggregate(over, F.lit(0).cast("long"), lambda acc, b: acc + b[name])

    counts = counts.select(F.transform(
        F.array(*[F.lit(t) for t in cuts]),
        lambda t, i: F.struct(t.alias("threshold"), above(i, "pos").alias("tp"), above(i, "neg").alias("fp"),
                              F.col("p").alias("p"), F.col("n").alias("n"))).alias("_cuts"))

    def with_rates(c: Column) -> Column:
        rates = _rates(c["tp"], c["fp"], c["n"] - c["fp"], c["p"] - c["tp"])
        return F.struct(c["threshold"].alias("threshold"), *[e.alias(n) for n, e in rates.items()])

    rated = counts.select(F.transform("_cuts", with_rates).alias("_cuts"))
    base = rated.withColumn("_base", F.element_at("_cuts", cuts.index(baseline) + 1))
    ok = lambda c: (
        (c["recall"] > F.col("_base.recall"))
        & (c["precision"] >= F.col("_base.precision") * (1 - tol))
        & (c["f1"] >= F.col("_base.f1") * (1 - tol)))
    in_grid = F.filter("_cuts", lambda c: c["threshold"].isin(*grid))
    chosen = base.withColumn("_best", F.array_max(F.transform(
        F.filter(in_grid, ok), lambda c: F.struct(c["recall"].alias("r"), (-c["threshold"]).alias("t")))))
    rows = chosen.select(F.explode(in_grid).alias("c"), "_base", "_best")
    eligible = ok(F.col("c"))
    return rows.select(
        "c.*", eligible.alias("eligible"),
        F.coalesce(F.col("c.threshold") == -F.col("_best.t"), F.lit(False)).alias("selected"))


def select_threshold(scored_val: DataFrame, **kwargs) -> float:
    """M8: the eligible threshold of highest recall (the lowest such); an error when there is none."""
    row = threshold_sweep(scored_val, **kwargs).where("selected").first()
    if row is None:
        raise ValueError("no threshold raises recall while precision and F1 stay within tolerance")
    return row["threshold"]
