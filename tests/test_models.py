from __future__ import annotations

import math
import random

import numpy as np
import pytest
from helpers import attempts_frame, random_chains
from pyspark.sql import functions as F

from edupulse.models import calibrate
from edupulse.models import classifiers as c
from edupulse.models import features as f
from edupulse.models.bootstrap import bootstrap_diff, draw, poisson_weight
from edupulse.operators.mastery import INITIAL_BKT, BktRule, bkt_trajectory
from edupulse.operators.metrics import classification_report, evaluate_predictions


def em_step(chains, rule):
    """Baum-Welch by enumeration of every hidden path of every chain."""
    sums = np.zeros(8)
    for chain in chains:
        total, stats = 0.0, np.zeros(8)
        for learned in range(len(chain) + 1):  # first known position; len = never
            known = [i >= learned for i in range(len(chain))]
            p = rule.prior if known[0] else 1 - rule.prior
            for i, ok in enumerate(chain):
                if i and not known[i - 1]:
                    p *= rule.transit if known[i] else 1 - rule.transit
                p *= ((1 - rule.slip) if ok else rule.slip) if known[i] else (rule.guess if ok else 1 - rule.guess)
            moves = [i for i in range(len(chain) - 1) if not known[i]]
            stats += p * np.array([
                known[0], 1, sum(known[i + 1] for i in moves), len(moves),
                sum(k and not ok for k, ok in zip(known, chain)), sum(known),
                sum(not k and ok for k, ok in zip(known, chain)), sum(not k for k in known)])
            total += p
        sums += stats / total
    return BktRule(sums[0] / sums[1], sums[2] / sums[3], sums[4] / sums[5], sums[6] / sums[7])


def parameters(rule):
    return rule.prior, rule.transit, rule.slip, rule.guess


@pytest.mark.parametrize("max_chain", [None, 5])
def test_em_equals_enumeration(spark, max_chain):
    chains = random_chains(students=5, length=9, hot=40, topics=("a",))
    path = calibrate.fit_path(attempts_frame(spark, chains), n_iter=3, max_chain=max_chain)
    rule, rows = BktRule(*INITIAL_BKT), [[ok for _, ok in seq] for seq in chains.values()]
    for got in path:
        rule = em_step(rows, rule)
        assert parameters(got) == pytest.approx(parameters(rule), abs=1e-9)


def sampled_chains(rule, students, seed):
    """Chains drawn from the two-state model, all of one length."""
    rng = np.random.default_rng(seed)
    known, steps = rng.random(students) < rule.prior, []
    for _ in range(9):
        right = rng.random(students) < np.where(known, 1 - rule.slip, rule.guess)
        steps.append(right)
        known |= rng.random(students) < rule.transit
    return {s: [("a", bool(step[s])) for step in steps] for s in range(students)}


def test_fit_finds_the_model_that_drew_the_chains(spark):
    rule = BktRule(0.35, 0.15, 0.08, 0.25)
    fitted = calibrate.fit_bkt(attempts_frame(spark, sampled_chains(rule, 2500, seed=31)), n_iter=40)
    assert parameters(fitted) == pytest.approx(parameters(rule), abs=0.08)


def test_empty_fit_is_an_error(spark):
    with pytest.raises(ValueError):
        calibrate.fit_bkt(attempts_frame(spark, {1: [("a", True)]}).where("false"), n_iter=1)


def test_selection_takes_the_first_minimum(spark):
    df = attempts_frame(spark, sampled_chains(BktRule(*INITIAL_BKT), 200, seed=4))
    got = calibrate.select_bkt(df.where("student_id < 150"), df.where("student_id >= 150"), candidates=(1, 2, 4))
    assert got.n_iter == min(got.val_log_loss, key=got.val_log_loss.get)
    again = calibrate.fit_bkt(df, n_iter=got.n_iter)
    assert parameters(got.params) == pytest.approx(parameters(again))


@pytest.mark.parametrize("max_rows", [None, 6])
def test_losses_of_all_candidates(spark, max_rows):
    df = attempts_frame(spark, random_chains(students=6, length=9, hot=30))
    rules = [BktRule(), BktRule(*INITIAL_BKT), BktRule(0.2, 0.3, 0.05, 0.45)]
    got = {r.candidate: (r.log_loss, r.n) for r in calibrate.candidate_losses(df, rules, max_rows=max_rows).collect()}
    for i, rule in enumerate(rules):
        rows = bkt_trajectory(df, params=rule)
        want = evaluate_predictions(rows, label="correct", prob="predicted").first()
        assert got[i][0] == pytest.approx(want["log_loss"], abs=1e-9) and got[i][1] == df.count()
    assert calibrate.candidate_losses(df.where("false"), rules).count() == 0


def test_bootstrap_weights_are_poisson(spark):
    rows = spark.range(500).selectExpr("id AS s", "explode(sequence(0L, 199L)) AS r")
    w = np.array(rows.select("s", "r", poisson_weight(draw(F.col("s"), F.col("r"), 42)).alias("w")).orderBy("s", "r").toPandas()["w"]).reshape(500, 200)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)
    assert [(w == k).mean() for k in range(4)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.01)
    # Neither neighbouring students nor neighbouring replicates go together.
    off = np.abs(np.corrcoef(w) - np.eye(500))
    assert off.mean() < 0.08 and off.max() < 0.45
    off = np.abs(np.corrcoef(w.T) - np.eye(200))
    assert off.mean() < 0.05 and off.max() < 0.3


def test_bootstrap(spark):
    rng = random.Random(0)
    rows = [(s, rng.random() < 0.6, 0.5, 0.6) for s in range(40) for _ in range(5)]
    df = spark.createDataFrame(rows, "student_id long, correct boolean, reference double, challenger double")
    same = bootstrap_diff(df, challenger="reference", n=200).first()
    assert (same.point, same.low, same.high) == (0.0, 0.0, 0.0)
    one, two = (bootstrap_diff(x, n=400).first() for x in (df, df.repartition(9)))
    assert one.low < one.point < one.high and one == pytest.approx(two)
    loss = lambda p: -sum(np.log(p if r[1] else 1 - p) for r in rows) / len(rows)
    assert one.point == pytest.approx(loss(0.6) - loss(0.5))
    with pytest.raises(ValueError):
        bootstrap_diff(df.withColumn("challenger", F.lit(None).cast("double")))


@pytest.fixture(scope="module")
def snapshot(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.25)
        rows.append((i, rng.choice("FM") if i % 17 else None, float(rng.gauss(2.0 * y, 1.0)) if i % 13 else None, rng.randint(0, 5), y))
    return spark.createDataFrame(rows, "id long, gender string, x double, noise long, y int").persist()


SET = f.FeatureSet("y", ["gender"], ["x", "noise"], ["id"])


def test_preprocess(spark, snapshot):
    prepare = f.fit_preprocess(snapshot, categorical=SET.categorical, numeric=SET.numeric)
    vectors = np.array([r.features.toArray() for r in prepare.transform(snapshot).collect()])
    assert vectors.shape[1] == 3 + 2  # F, M, Unknown; two numbers
    assert vectors[:, 3:].mean(axis=0) == pytest.approx([0, 0], abs=1e-9)
    assert vectors[:, 3:].std(axis=0) == pytest.approx([1, 1])
    median = np.median([r.x for r in snapshot.collect() if r.x is not None])
    new = spark.createDataFrame([(1, "X", None, 1, 0)], snapshot.schema)
    filled = prepare.transform(new).first()
    values = [r.x if r.x is not None else median for r in snapshot.collect()]
    assert filled.features.toArray()[:3].tolist() == [0, 0, 0]
    assert filled["_n_x"] == pytest.approx((median - np.mean(values)) / np.std(values))


def test_an_iteration_takes_the_tasks_its_outcomes_need(spark, monkeypatch):
    frame = attempts_frame(spark, random_chains(students=40, length=12, seed=9))
    store = calibrate.compress_chains(frame)
    assert store.tasks == 1
    store.close()
    one = calibrate.fit_bkt(frame, n_iter=3)
    monkeypatch.setattr(calibrate, "TASK_CELLS", 20)
    many = calibrate.fit_bkt(frame, n_iter=3)
    for name in ("prior", "transit", "slip", "guess"):
        assert getattr(many, name) == pytest.approx(getattr(one, name), abs=1e-12)


def test_balanced_logistic(spark, snapshot):
    model = c.fit_logistic(snapshot, features=SET)
    rows = c.score(model, snapshot)
    report = classification_report(rows, label="y").first()
    assert report.auc > 0.85 and report.recall > 0.7
    # The optimum of the weighted objective: its gradient vanishes.
    stages = model.stages
    x = np.array([r.features.toArray() for r in stages[0].transform(snapshot).orderBy("id").collect()])
    y = np.array([r.y for r in snapshot.orderBy("id").collect()])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, intercept = stages[1].coefficients.toArray(), stages[1].intercept
    error = w * (1 / (1 + np.exp(-(x @ beta + intercept))) - y)
    assert error.sum() == pytest.approx(0, abs=0.05)
    assert x.T @ error + beta == pytest.approx(np.zeros(x.shape[1]), abs=0.05)


def test_forest_and_saving(spark, snapshot, tmp_path):
    model = c.fit_forest(snapshot, features=SET, trees=20)
    assert classification_report(c.score(model, snapshot), label="y").first().auc > 0.85
    model.write().save(str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "model"))
    assert c.score(again, snapshot).orderBy("id").collect() == c.score(model, snapshot).orderBy("id").collect()


def test_forest_keeps_the_nodes_of_rows(snapshot):
    assert c.fit_forest(snapshot, features=SET, trees=2).stages[-1].getCacheNodeIds()


def test_one_class_is_an_error(spark, snapshot):
    with pytest.raises(ValueError):
        c.fit_logistic(snapshot.where("y = 0"), features=SET)


def test_heldout_only(spark):
    scored = spark.createDataFrame([(1, 0.7, 1, "test"), (2, 0.6, 1, "train")], "k long, prob double, predicted_class int, split string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    rows = {r.k: (r.prob, r.withheld_reason) for r in c.serve_heldout(asked, scored, keys=["k"]).collect()}
    assert rows == {1: (0.7, None), 2: (None, "in-sample"), 3: (None, "missing")}


def test_out_of_fold_never_sees_its_key(spark, snapshot):
    seen = []

    def fit(rows):
        seen.append({r.id for r in rows.select("id").collect()})
        return c.fit_logistic(rows, features=SET)

    scored = c.out_of_fold(snapshot, fit, folds=3, key="id").collect()
    assert sorted(r.id for r in scored) == list(range(400))
    for r in scored:
        assert r.id not in seen[r.fold]


def test_feature_lists_have_no_identifiers_or_targets():
    for s in (f.DROPOUT, f.PERFORMANCE, f.ATTENDANCE, f.OCCUPANCY, f.ABSENCE):
        assert not {*s.identifiers, s.target} & set(s.features)
        assert not {"final_result", "date_unregistration", "score"} & set(s.features)
