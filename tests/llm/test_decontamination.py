from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import pytest
from rows import as_documents, messy_rows, prose

from edupulse.llm import decontamination

ITEM = "item_id long, text string, words string"


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "w") for i, t in items], ITEM)


def check(documents, rows, items, **options):
    got = sorted((tuple(r) for r in decontamination.report(documents, items, **options).collect()), key=repr)
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    want = []
    for i, t in rows:
        n, hit, named = brute.contamination(t, pairs)
        want.append((i, n, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=repr)
    return got


def test_rows(spark, messy):
    texts = {i: t for i, t in messy_rows() if t}
    items = [(1, " ".join(texts[7].split()[20:50])), (1, "nothing of this kind"), (2, texts[20][30:200]), (3, None), (4, " -- !"), (5, "two WORDS"), (6, "日本"), (None, texts[15][500:700]),
             (30, "word"), (7, " ".join(prose(random.Random(1), 40).split()))]
    got = check(messy, messy_rows(), items_of(spark, items))
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_blocks_give_the_same(spark, messy, monkeypatch):
    texts = {i: t for i, t in messy_rows() if t}
    items = items_of(spark, [(k, " ".join(texts[7].split()[k: k + 12 + k])) for k in range(0, 60, 7)] + [(99, texts[10][:90])])
    want = sorted(map(tuple, decontamination.report(messy, items).collect()), key=repr)
    blocks = decontamination._blocks
    monkeypatch.setattr(decontamination, "_blocks", lambda b, n: blocks(b, 300))
    assert sorted(map(tuple, decontamination.report(messy, items).collect()), key=repr) == want


@pytest.mark.parametrize("seed", range(3))
def test_few_words_and_many_overlaps(spark, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(["a", "B", "c"]) for _ in range(n))
    rows = [(i, line(rng.randrange(120))) for i in range(40)]
    check(as_documents(spark, rows), rows, items_of(spark, [(i, line(rng.randrange(6, 30))) for i in range(12)]))


def test_suffix_array_sorts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 300)
    order = decontamination.suffix_array(text, 400)
    suffixes = [tuple(text[i:]) for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(300))


def test_longest_matches():
    item = "one two three four five six seven eight nine ten eleven twelve"
    windows = decontamination.Windows.of([("x", item.encode())], 10)
    text = "start one two three four five six seven eight nine ten eleven end two three four five six seven eight nine ten eleven twelve"
    (n, spans, named, matches), = decontamination.search([text.encode()], windows)
    assert n == 24 and spans == [(1, 12), (13, 24)] and named == {"x"}
    assert sorted(matches) == [("x", 1, 0, 11), ("x", 13, 1, 11)]


def test_documents_that_hold_an_item_go(spark, messy):
    texts = {i: t for i, t in messy_rows() if t}
    items = items_of(spark, [(1, texts[17] if texts.get(17) else texts[18]), (2, " ".join(texts[15].split()[100:120]))])
    kept = decontamination.decontaminate(messy, items)
    assert kept.columns == messy.columns and kept.where("doc_id = 15").count() == 0
    clean = decontamination.report(messy, items).where("not contaminated").count()
    assert kept.count() == clean


def test_nothing(spark, messy, nothing):
    none = items_of(spark, [])
    assert decontamination.report(nothing, none).count() == 0
    assert decontamination.report(messy, none).where("contaminated").count() == 0 and decontamination.decontaminate(messy, none).count() == messy.count()
