from __future__ import annotations

import random
from collections import defaultdict

import brute
import pytest

from edupulse.llm import packing
from rows import messy_rows


def check_plan(histogram, capacity):
    plan = packing.plan_patterns(histogram, capacity)
    used = defaultdict(int)
    for times, parts in plan:
        assert times > 0 and sum(length * n for length, n in parts) <= capacity
        for length, n in parts:
            used[length] += n * times
    assert used == {k: v for k, v in histogram.items() if v}
    return sum(times for times, _ in plan)


def test_exact_complements_are_found():
    assert check_plan({60: 2, 40: 1, 30: 1, 10: 1}, 100) == 2  # one pair, one triple
    assert check_plan({70: 1, 10: 1, 12: 1, 8: 1}, 100) == 1
    assert check_plan({50: 5}, 100) == 3
    assert check_plan({100: 7}, 100) == 7
    assert check_plan({}, 100) == 0


@pytest.mark.parametrize("seed", range(8))
def test_every_piece_has_its_place_and_sequences_are_few(seed):
    rng = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[min(256, 1 + int(rng.expovariate(1 / 40)))] += 1
    total = sum(k * v for k, v in histogram.items())
    assert check_plan(dict(histogram), 256) <= -(-total // 256) + 1


def test_queries_rows(spark, messy, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)  # salts
    rows = [r.asDict() for r in packing.pack(messy).collect()]
    own, want = brute.tokenizer("word_bpe_49k.json"), defaultdict(int)
    for i, text in messy_rows():
        ids = brute.ids(own, text)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at: at + 2048]
            want[i, piece, at, len(part), brute.crc(part)] += 1
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_ids_can_come_along(spark, messy):
    own = brute.tokenizer("word_bpe_49k.json")
    rows = packing.pack(messy.where("doc_id = 15"), with_ids=True).orderBy("piece").collect()
    assert sum((r["ids"] for r in rows), []) == brute.ids(own, dict(messy_rows())[15]).tolist()


def test_nothing(nothing):
    assert packing.pack(nothing).count() == 0
