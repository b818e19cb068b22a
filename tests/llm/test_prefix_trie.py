from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from edupulse.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, n double, block int, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(rng: random.Random, conversations: int, texts: int = 3, most: int = 7) -> list[tuple]:
    """Conversations over few texts, so that prefixes of every length are shared."""
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["é", "ab", "the third text", "x" * 40][:texts]))
            for c in range(conversations) for t in range(rng.randrange(1, most))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 0.5, 1, "p") for r in rows], SCHEMA)


def plain(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()) for path, convs in members.items())


def got(spark, rows, block_rows=None):
    found = prefix_trie.trie(prefix_trie.rebuild(frame(spark, rows)), block_rows)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block_rows", [None, 40, 7, 2])
def test_nodes(spark, block_rows):
    rows = talks(random.Random(1), 330)
    # A long conversation, a beginning of it, and one conversation many times over.
    rows += [(1000 + k, t, "user", f"turn {t}") for k, n in enumerate([150, 90, 149]) for t in range(n)]
    rows += [(2000 + k, t, "user", "same") for k in range(120) for t in range(3)]
    assert got(spark, rows, block_rows) == plain(rows)


@pytest.mark.parametrize("block_rows", [None, 3])
def test_odd_rows(spark, block_rows):
    rows = [
        (None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 0, None, "a"), (1, 0, "", "a"), (1, 0, "user", None), (1, 2, "user", ""),
        (1, 2, "user", ""), (300, 0, "user", "base"), (301, 5, "user", "only one"), (302, 0, "user", "base"), (-7, 0, "user", "a"), (-100, 0, "x", "b"), (-101, 3, "x", "b"),
        (7, 0, "1", "2:3"), (8, 0, "1:2", "3"), (9, 0, "user", "long " * 30_000)]
    assert got(spark, rows, block_rows) == plain(rows)


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_runs_of_ids_are_one_hash(spark, monkeypatch):
    rows = [(100 * c, 0, "user", "same") for c in range(9_000)]
    (root, leaf) = got(spark, rows)
    assert leaf[3] == 9_000 and leaf[7] == hashlib.sha256(",".join(str(100 * c) for c in range(9_000)).encode()).hexdigest()
    assert root[6] == leaf[6] == 8_999 * 4 and root[7] == prefix_trie.NOTHING


def test_range_minimum():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 65):
        values = rng.integers(0, 6, n)
        table = prefix_trie.RangeMinimum(values)
        for _ in range(60):
            a, b = sorted(rng.integers(0, n, 2))
            bound = int(rng.integers(0, 7))
            assert table.minimum(np.array([a]), np.array([b]))[0] == values[a: b + 1].min()
            right = max(q for q in range(a, n) if (values[a + 1: q + 1] >= bound).all())
            left = min(q for q in range(a + 1) if (values[q + 1: a + 1] >= bound).all())
            assert table.right(np.array([a]), np.array([bound]))[0] == right and table.left(np.array([a]), np.array([bound]))[0] == left
