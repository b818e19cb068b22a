from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from edupulse.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score double, block string, anchor int"
MOST = 2**63 - 1


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "b", 2) for r in rows], SCHEMA)


def plain(rows):
    known = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * Fraction(float(np.float32(x)))) for x in v]
        known.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, v))

    def score(a, b):
        return max(-MOST, min(MOST, sum(x * y for x, y in zip(a[2], b[2], strict=False))))

    out, done = [], []
    for k, a in enumerate(known):
        if a[0] is None or a[0] % 100 or a in done:
            continue
        done.append(a)

        def key(b, a=a):
            return -score(a, b), b[0] is None, b[0] or 0

        alike = sorted((b for j, b in enumerate(known) if j != k and b[1] == a[1]), key=key)[:5]
        other = sorted((b for b in known if b[1] != a[1]), key=key)
        for p in alike:
            s = score(a, p)
            inside = [b for b in other if 30 * s <= 100 * score(a, b) <= 90 * s][:10]
            out += [(a[0], p[0], r, b[0], s, score(a, b)) for r, b in enumerate(inside, 1)]
    return sorted(out, key=str)


def got(spark, rows, block_rows=None):
    found = h.mine(frame(spark, rows), block_rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(rng, n, dims=20):
    middle = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(4)]
    return [(i, [float(np.float32(rng.gauss(c, 0.3))) for c in rng.choice(middle)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("block_rows", [None, 50])
def test_negatives(spark, block_rows):
    rows = vectors(random.Random(2), 700)
    want = plain(rows)
    assert len(want) > 100 and got(spark, rows, block_rows) == want


@pytest.mark.parametrize("block_rows", [None, 9])
def test_odd_rows(spark, monkeypatch, block_rows):
    monkeypatch.setattr(h, "BLOCK_ROWS", 4)
    rng = random.Random(4)
    rows = vectors(rng, 120, 9)
    # One vector many times over, repeated rows, repeated anchors, equal ids, null ids.
    rows += [(200 + k, rows[5][1], 1) for k in range(40)] + rows[:3] * 2 + [rows[100]] * 9 + [(100, rows[7][1], 2), (None, rows[8][1], 1), (None, rows[9][1], 2), (-100, rows[3][1], 3)]
    # Other lengths, zeros, large and very large components.
    rows += [(300, [], 1), (301, [1.0], 1), (400, [0.5] * 30, 2), (401, [0.0] * 9, 2), (500, [3e5] * 9, 1), (501, [-3e5] * 9, 1), (502, [2e5] * 9, 2), (600, [3e38] * 9, 3), (601, [1e37] * 9, 1)]
    rows += [(700, None, 1), (701, [float("nan")] * 9, 1), (702, [float("inf")] * 9, 1), (703, [None, 1.0], 1), (704, [1.0] * 9, None), (800, [-1.0] * 9, 1), (805, [1.0] * 9, 1)]
    assert got(spark, rows, block_rows) == plain(rows)


def test_nothing(spark):
    assert got(spark, []) == [] and got(spark, [(1, [1.0], 1)]) == [] and got(spark, [(100, [1.0], 1)]) == []


def test_tables_give_the_inner_product():
    rng = np.random.default_rng(1)
    for dims, most in ((8, 3), (16, 300), (24, 2**20)):
        a, b = rng.integers(-most, most, (5, dims)), rng.integers(-most, most, (40, dims))
        planes = most.bit_length() + 1
        bits = h.pack(b, planes)
        assert (h.scores(h.subset_sums(a), bits) == b @ a.T).all()
        assert all((h.unpack(row.tobytes(), planes) == v).all() for row, v in zip(bits, b, strict=True))
    assert h.subset_sums(np.arange(1, 9).reshape(1, 8))[0, 0b10000101, 0] == 1 + 3 + 8
