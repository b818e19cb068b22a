from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import as_documents, prose

from edupulse.llm import jaccard, simhash
from edupulse.llm.components import connected_components
from edupulse.llm.staging import among


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def families(rng: random.Random) -> list[tuple[int, str]]:
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(60, 400), vocabulary=4000)
        texts += [base, *(edited(rng, base, rng.randrange(1, 9)) for _ in range(9))]
    return list(enumerate(texts))


@pytest.mark.parametrize("pair_rows", [2, 16])
def test_links_of_similar_texts(spark, monkeypatch, pair_rows):
    """Every link holds; with small groups nearly every similar pair is linked, with large ones it is reachable."""
    monkeypatch.setattr(jaccard, "PAIR_ROWS", pair_rows)
    rows = families(random.Random(8))
    sketches = simhash.fingerprints(as_documents(spark, rows), sketches=True).cache()
    of = {r["doc_id"]: r["fp"] for r in sketches.collect()}
    texts = {of[i]: t for i, t in rows}
    edges = {(r["a"], r["b"]) for r in jaccard.links(sketches).collect()}
    assert edges and all(brute.similarity(texts[a], texts[b]) >= 0.8 for a, b in edges)
    edges = {(min(e), max(e)) for e in edges}
    part = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    want = [(a, b) for a in texts for b in texts if a < b and brute.similarity(texts[a], texts[b]) >= 0.8]
    reached = sum(a in part and part[a] == part.get(b) for a, b in want)
    print("reached", reached, "of", len(want))
    assert len(want) > 50 and reached >= 0.95 * len(want)


def test_one_of_similar_texts_stays(spark):
    rng = random.Random(4)
    base, other = prose(rng, 200, 4000), prose(rng, 200, 4000)
    near, far = edited(rng, base, 3), edited(rng, base, 40)
    assert brute.similarity(base, near) >= 0.8 > brute.similarity(base, far)
    rows = [(5, near), (3, base), (9, far), (8, other), (None, None), (1, "a b"), (2, "a c")]
    assert sorted(r["doc_id"] or -1 for r in simhash.near_dedup(as_documents(spark, rows)).collect()) == [-1, 1, 2, 3, 8, 9]


def test_sketches():
    rng = random.Random(2)
    text = prose(rng, 9000).lower().encode().split()
    found = jaccard.shingles(text)
    assert len(found) == len({tuple(text[i: i + 5]) for i in range(len(text) - 4)})
    bands, further = jaccard.sketch(found)
    whole = (found[:, None] * jaccard._ODD + jaccard._ADD).min(0)
    assert len(bands) == 16 and np.array_equal(further, whole[-28:])
    assert len(jaccard.shingles([b"a", b"b"])) == 1 and not len(jaccard.sketch(jaccard.shingles([]))[0])


def test_only_candidates_have_shingle_sets(spark, tmp_path, monkeypatch):
    """What links stage and shuffle follows the texts that may be similar, not the table."""
    rng = random.Random(6)
    base = prose(rng, 300, 4000)
    rows = list(enumerate([base, edited(rng, base, 2), *(prose(rng, 300, 4000) for _ in range(30))]))
    staged = []
    monkeypatch.setattr(jaccard, "stage", lambda df: staged.append(df.cache()) or staged[-1])
    documents = as_documents(spark, rows)
    sketches = simhash.fingerprints(documents, sketches=True, sets=False).cache()
    assert "shingles" not in sketches.columns
    assert jaccard.links(sketches, documents).count() == 1
    assert [df.count() for df in staged if "shingles" in df.columns] == [2]


def test_among_keeps_all_that_is_wanted(spark):
    rows, wanted = spark.range(5000), spark.range(0, 5000, 50).select((F.col("id") * 3 - 900).alias("x"))
    kept = {r["id"] for r in among(rows, "id", wanted).collect()}
    assert {r["x"] for r in wanted.collect()} & set(range(5000)) <= kept and len(kept) < 150
