from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from rows import messy_rows

from edupulse.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4096, 4097, 50_000])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    y = sharding.permute(x, n)
    assert sorted(y) == list(range(n)) and (sharding.unpermute(y, n) == x).all()


def test_order_is_shuffled_and_depends_on_the_key():
    x = np.arange(20_000)
    y = sharding.permute(x, len(x))
    assert abs(np.corrcoef(x, y)[0, 1]) < 0.03 and (y == sharding.permute(x, len(x))).all() and (y != sharding.permute(x, len(x), seed=7)).mean() > 0.99


def test_rows(messy):
    rows = sharding.shard_documents(messy).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in messy_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
        assert sharding.row_of(r["shard"], r["slot"], len(rows)) == r["row_number"]
    assert all(sorted(s) == list(range(len(s))) for s in places.values())
    sizes = [len(places[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_nothing(nothing):
    assert sharding.shard_documents(nothing).count() == 0
