from __future__ import annotations

import random

import numpy as np
import brute
import pytest

from edupulse.llm import substrings
from rows import as_documents, messy_rows


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect()), key=repr)


def test_rows(messy):
    assert rows_of(substrings.report(messy)) == sorted(brute.repeats(messy_rows()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets_runs_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdef") for _ in range(rng.randrange(40, 200))] for _ in range(6)] + [["r"] * 130, ["r", "s"] * 60]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a: a + rng.randrange(30, 160)] + [str(rng.randrange(10**6))] * rng.randrange(3)
        rows.append((rng.randrange(40), " ".join(words)))
    assert rows_of(substrings.report(as_documents(spark, rows))) == sorted(brute.repeats(rows), key=repr)


def test_equal_windows_have_equal_anchors():
    """Whatever surrounds them: the anchor of a window depends on its words alone."""
    rng = random.Random(4)
    inner = " ".join(rng.choice(["a", "b", "cc", "d", "e", "a"]) for _ in range(160)).encode()
    texts = [b" ".join(filter(None, [" ".join(rng.choice("abxyz") for _ in range(rng.randrange(40))).encode(), inner, " ".join(rng.choice("aaabz") for _ in range(rng.randrange(40))).encode()]))
             for _ in range(40)]
    hashed, doc, symbol, _, first, last = substrings.anchors(texts)
    seen: dict[tuple[bytes, ...], set[int]] = {}
    for d, s, a, b in zip(doc, symbol, first, last, strict=True):
        for p in range(a, b + 1):
            seen.setdefault(tuple(hashed.split[d][p: p + substrings.WINDOW]), set()).add(int(s))
    assert all(len(s) == 1 for s in seen.values()) and len(seen) > 111
    covered = np.zeros(int(hashed.counts.sum()))
    for d, a, b in zip(doc, first, last, strict=True):
        covered[hashed.begin[d] + a: hashed.begin[d] + b + 1] += 1
    assert covered.max() == 1 and covered.sum() == sum(max(0, n - substrings.WINDOW + 1) for n in hashed.counts)


def test_texts_without_repeats(messy):
    texts = sorted(((r["doc_id"], r["text"]) for r in substrings.remove_repeats(messy).collect()), key=repr)
    want = dict(zip([r[0] for r in messy_rows()], messy_rows(), strict=True))
    assert len(texts) == messy.count()
    assert (1, None) in texts and (15, want[15][1]) in texts and (8, "") in texts


def test_windows_of_repeated_rows_grow_with_the_rows(spark):
    rng = random.Random(3)
    words = [str(rng.randrange(10**6)) for _ in range(160)]
    one = [(1, " ".join(words)), (2, " ".join(["x", *words[:120], "y"]))]

    def windows(copies):
        rows = as_documents(spark, one * copies)
        chunks = substrings.described(rows).selectExpr("doc_id", "text_hash", "explode(anchors) AS a").select("doc_id", "text_hash", "a.*")
        return substrings._open_windows(rows, chunks, substrings.WINDOW).count()

    assert windows(30) == 30 * windows(1)
    assert rows_of(substrings.report(as_documents(spark, one * 30))) == sorted(brute.repeats(one * 30), key=repr)


def test_nothing(nothing):
    assert substrings.report(nothing).count() == 0
