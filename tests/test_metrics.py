from __future__ import annotations

import math
import random

import pytest

from edupulse.operators import metrics as m
from edupulse.operators.splits import split_by_key, stratified_split


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prob double").repartition(5)


def random_rows(n=3000, seed=4, digits=2):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.2 + 0.5 * (p := round(rng.random(), digits))), p) for _ in range(n)]


def auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [2, 9])
def test_evaluate_matches_definitions(spark, digits):
    rows = random_rows(800, digits=digits)
    got = m.evaluate_predictions(scored(spark, rows)).first()
    clip = [(y, min(1 - 1e-9, max(1e-9, p))) for y, p in rows]
    assert got.n_predictions == len(rows)
    assert got.log_loss == pytest.approx(-sum(math.log(p if y else 1 - p) for y, p in clip) / len(rows))
    assert got.accuracy == pytest.approx(sum((p >= 0.5) == bool(y) for y, p in rows) / len(rows))
    assert got.brier_score == pytest.approx(sum((y - p) ** 2 for y, p in rows) / len(rows))
    assert got.rmse == pytest.approx(math.sqrt(got.brier_score))
    assert got.auc == pytest.approx(auc(rows))


@pytest.mark.parametrize("row", [(1, None), (0, float("nan")), (None, 0.5)])
@pytest.mark.parametrize("score", [m.evaluate_predictions, m.classification_report, m.threshold_sweep])
def test_missing_probability_or_label_is_an_error(spark, row, score):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1), row], "label int, prob double")
    with pytest.raises(Exception, match="missing prob or label"):
        score(rows).collect()


def test_single_class_and_boundaries(spark):
    got = m.evaluate_predictions(scored(spark, [(1, 1.0), (1, 0.0)])).first()
    assert got.auc is None and got.brier_score == 0.5
    assert got.log_loss == pytest.approx(-math.log(1e-9) / 2, rel=1e-6)


def test_report_identities(spark):
    rows = random_rows()
    for t in (0.2, 0.5, 0.8):
        r = m.classification_report(scored(spark, rows), threshold=t).first()
        assert r.tp == sum(y and p >= t for y, p in rows) and r.fp == sum(not y and p >= t for y, p in rows)
        assert r.tp + r.fn == r.positives and r.tn + r.fp == r.negatives
        assert r.precision == pytest.approx(r.tp / (r.tp + r.fp)) and r.recall == pytest.approx(r.tp / r.positives)
        assert r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall))
        assert r.accuracy == pytest.approx((r.tp + r.tn) / len(rows))
    empty = m.classification_report(scored(spark, [(0, 0.1), (1, 0.2)]), threshold=0.9).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_sweep_against_reports(spark):
    rows = random_rows()
    sweep = m.threshold_sweep(scored(spark, rows)).orderBy("threshold").collect()
    assert [r.threshold for r in sweep] == m.threshold_grid() and len(sweep) == 31
    assert [r.recall for r in sweep] == sorted((r.recall for r in sweep), reverse=True)
    for r in sweep[::6]:
        whole = m.classification_report(scored(spark, rows), threshold=r.threshold).first()
        assert (r.precision, r.recall, r.f1) == pytest.approx((whole.precision, whole.recall, whole.f1))


def test_select_threshold(spark):
    # Ten positives at 0.45 are found by lowering the threshold without new false alarms.
    rows = [(1, 0.9)] * 10 + [(1, 0.45)] * 10 + [(0, 0.6)] * 2 + [(0, 0.1)] * 30
    df = scored(spark, rows)
    assert m.select_threshold(df) == 0.2
    chosen = m.threshold_sweep(df).where("selected").collect()
    assert [r.threshold for r in chosen] == [0.2]
    with pytest.raises(ValueError):
        m.select_threshold(scored(spark, [(1, 0.9), (0, 0.1)]))


def test_split_by_key_is_disjoint(spark):
    df = spark.range(5000).selectExpr("id % 500 as student_id", "id")
    rows = split_by_key(df, key="student_id", fractions={"train": 0.8, "test": 0.2}).groupBy("student_id").agg(
        {"split": "min", "id": "count"}).collect()
    assert len(rows) == 500
    again = split_by_key(df.repartition(3), key="student_id", fractions={"train": 0.8, "test": 0.2})
    parts = {r["split"]: r["count"] for r in again.select("student_id", "split").distinct().groupBy("split").count().collect()}
    assert sum(parts.values()) == 500 and 0.7 < parts["train"] / 500 < 0.9
    assert {r.student_id: r["min(split)"] for r in rows} == {r.student_id: r.split for r in again.select("student_id", "split").distinct().collect()}


def test_stratified_shares(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 5 = 0 as int) as y")
    parts = {(r.y, r.split): r["count"] for r in stratified_split(df, label="y", key="id").groupBy("y", "split").count().collect()}
    assert parts == {(0, "train"): 240, (0, "val"): 80, (0, "test"): 80, (1, "train"): 60, (1, "val"): 20, (1, "test"): 20}
