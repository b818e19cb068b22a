from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from rows import prose

from edupulse.llm import toxicity

INSULTS = ["glorbag", "snivelnik", "crudwit"]
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 80)).split()
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(rng.randrange(1, len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic, "no text"))
    return rows, labels


@pytest.fixture(scope="module")
def learnt(spark):
    rows, labels = corpus(1200)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    return docs, marks, toxicity.fit(docs, marks)


def test_held_out_documents(learnt):
    docs, marks, model = learnt
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


@pytest.mark.parametrize("written", ["glorbag", "GLORBAG!", "glor-bag", "gl0rbag", "g l o r b a g", "g.l.o.r.b.a.g", "glorxbag", "glorbagg", "snivelniks"])
def test_spellings(learnt, written):
    _, _, model = learnt
    plain, said = model.probability(toxicity.Scorer(model).margins(["ba kelo minu sti lo mi.", f"ba kelo minu {written} sti lo mi."]))
    assert plain < 0.1 < 0.7 < said


def test_kernel_by_definition():
    def value(a, b):
        a, b = ([x for x in row if x >= 0] for row in (toxicity._codes([a])[0], toxicity._codes([b])[0]))

        def grams(x):
            out = {}
            for i in range(len(x)):
                for j in range(i + 1, min(i + toxicity.SPAN, len(x))):
                    for k in range(j + 1, min(i + toxicity.SPAN, len(x))):
                        out.setdefault((x[i], x[j], x[k]), []).append(toxicity.DECAY ** (k - i - 2))
            return out

        x, y = grams(a), grams(b)
        norm = lambda g: sum(w * w for ws in g.values() for w in ws) ** 0.5
        return sum(sum(x[g]) * sum(y[g]) for g in x if g in y) / (norm(x) * norm(y))

    words = ["banana", "bandana", "an", "nab", "kelomi", "é", "xylophone"]
    kernel = toxicity.Kernel(["banana", "kelo"])
    got = kernel.values(words)
    for i, w in enumerate(words):
        for j, m in enumerate(kernel.landmarks):
            assert got[i, j] == pytest.approx(v * v if (v := value(w, m)) >= toxicity.FLOOR else 0, abs=1e-5)


def test_memory_does_not_change_margins(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, 12) for _ in range(200)] + ["kelomi" * 20, ""]
    model = toxicity.Model(["kelomi", "baba"], np.array([1.0, 2.0]), -1.0, 1.0, 0.0)
    want = toxicity.Scorer(model).margins(texts)
    assert len(set(want)) > 3
    monkeypatch.setattr(toxicity, "MEMORY", 10)
    small = toxicity.Scorer(model)
    got = np.concatenate([small.margins(texts[i: i + 3]) for i in range(0, len(texts), 3)])
    assert np.allclose(got, want, atol=1e-6)


def test_odd_inputs(spark, messy, nothing, learnt):
    _, _, model = learnt
    rows = toxicity.score(messy, model).collect()
    assert len(rows) == messy.count() and all(r["score"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.score(nothing, model).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in toxicity.report(messy, none).collect()} == {0}
    one_kind = spark.createDataFrame([(7, 1, 0, None), (8, 1, 0, None), (None, 1, 1, None), (9, 1, None, None), (10, 1, 0, None), (10, 1, 1, None)], LABELS)
    assert {r["predicted"] for r in toxicity.report(messy, one_kind).collect()} == {0}
    assert toxicity.report(nothing, none).count() == 0
