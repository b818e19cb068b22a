from __future__ import annotations

import math
import random

import brute
import pytest
from pyspark.sql import functions as F
from rows import as_documents, messy_rows, prose

from edupulse.llm import quality_rules

LABELS = "doc_id long, quality int, toxic int, lang string"


def test_statistics_and_base_rule(spark, messy):
    labels = spark.createDataFrame([(7, 1, 0, "x"), (7, 0, 0, "x"), (None, 1, 0, "x"), (10, None, 1, None), (999, 0, 0, None)], LABELS)
    rows = quality_rules.report(messy, labels).collect()
    want = []
    for i, text in messy_rows():
        found = brute.statistics(text)
        want.append((i, *found, found[0] < 50 or 100 * found[4] > 50 * found[0]))
    assert sorted((tuple(r)[:7] for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # no label, no cutoff


def test_no_python(messy, spark):
    plan = quality_rules.report(messy, spark.createDataFrame([], LABELS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.3), (200, 3, 0.005), (5000, 20, 0.005), (40_000, 180, 0.005)])
def test_binomial_tail(spark, n, k, p):
    row = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert row["x"] == pytest.approx(want, rel=1e-9)


@pytest.fixture(scope="module")
def labelled(spark):
    """Many good texts, some with a few symbols, and bad ones full of them, in one large and one small stratum."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(2600):
        bad = i % 10 == 0
        text = prose(rng, 55)
        if bad:
            text = " ".join(w + "***" for w in text.split())
        elif i % 400 == 1:
            text += " #1"
        rows.append((i, text, "big" if i < 2550 else "small"))
        labels.append((i, 0 if bad else 1, 0, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)


def test_cutoffs_reject_bad_and_bound_the_loss(labelled):
    docs, labels = labelled
    statistics = quality_rules.base_statistics(docs, "doc_id", "lang")
    limits = {r["stratum"]: r for r in quality_rules.cutoffs(statistics, labels).collect()}
    assert set(limits) == {"big"}  # the small stratum cannot show anything
    assert limits["big"]["_cut_symbols"] is not None and limits["big"]["_cut_lines"] is None
    rows = quality_rules.report(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert not any(r["kept"] for r in rows if r["doc_id"] % 10 == 0 and r["lang"] == "big")
    assert all(r["kept"] for r in rows if r["doc_id"] % 10)
    assert quality_rules.filter_documents(docs.withColumn("_row", F.lit(1)), labels).columns == ["doc_id", "text", "lang", "_row"]
    kept = quality_rules.filter_documents(docs, labels)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_all_labels_choose(labelled, monkeypatch):
    monkeypatch.setattr(quality_rules, "HOLDOUT", 300, raising=False)
    docs, labels = labelled
    limits = quality_rules.cutoffs(quality_rules.base_statistics(docs, "doc_id", "lang"), labels).collect()
    assert [(r["stratum"], r["_cut_symbols"] is not None) for r in limits] == [("big", True)]


@pytest.mark.parametrize("n,k", [(400_000_000, 1_996_000), (400_000_000, 1_980_000), (3_000_000, 14_900)])
def test_binomial_tail_of_many(spark, n, k, p=0.005):
    row = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()
    # Normal law with the first correction for skewness, which is off by about 1 / (n p) here.
    sd = math.sqrt(n * p * (1 - p))
    z = (k + 0.5 - n * p) / sd
    want = math.erfc(-z / math.sqrt(2)) / 2 - (1 - 2 * p) / (6 * sd) * (z * z - 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    assert row["x"] == pytest.approx(want, rel=1e-3)


def test_bad_labels_alone_or_noise_give_no_cutoff(labelled):
    docs, labels = labelled
    statistics = quality_rules.base_statistics(docs, "doc_id", "lang")
    noise = labels.withColumn("quality", (F.xxhash64("doc_id") % 2 == 0).cast("int"))
    assert quality_rules.cutoffs(statistics, noise).count() == 0
    assert quality_rules.cutoffs(statistics, labels.where("quality = 0")).count() == 0


def test_nothing(spark, nothing):
    empty = spark.createDataFrame([], LABELS)
    assert quality_rules.report(nothing, empty).count() == 0 and quality_rules.filter_documents(nothing, empty).count() == 0
    assert quality_rules.filter_documents(as_documents(spark, [(1, "a b")]), empty).count() == 0
