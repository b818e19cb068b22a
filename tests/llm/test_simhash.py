from __future__ import annotations

import random

import brute
import pytest

from edupulse.llm import simhash
from edupulse.llm.components import connected_components
from rows import as_documents, messy_rows, prose


def test_rows(messy):
    rows = messy_rows()
    prints = [brute.fingerprint(t) for _, t in rows]
    parts = brute.components(prints)
    keys = [brute.LAST if i is None else i for i, _ in rows]
    least: dict[int, int] = {}
    for part, key in zip(parts, keys, strict=True):
        least[part] = min(least.get(part, key), key)
    back = lambda k: None if k == brute.LAST else k
    want = sorted(((back(k), f"{p:016x}", back(least[c])) for k, p, c in zip(keys, prints, parts, strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash.report(messy).collect()), key=repr) == want


@pytest.mark.parametrize("pair_rows", [0, 3, 32])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, pair_rows):
    """Families around a few centres; keys that many share go by their neighbourhoods."""
    monkeypatch.setattr(simhash, "PAIR_ROWS", pair_rows)
    rng = random.Random(11)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {0, 1, 3, 7, 2**64 - 1, 2**63, 2**63 + 1}
    ordered = sorted(values)
    rows = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in ordered], "fp long")
    edges = simhash.links(rows)
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in edges.collect())
    label = {r["node"] % 2**64: r["component"] for r in connected_components(edges).collect()}
    want = brute.components(ordered)
    groups: dict[object, set[int]] = {}
    for x in ordered:
        groups.setdefault(label.get(x, ("alone", x)), set()).add(x)
    expected: dict[int, set[int]] = {}
    for x, c in zip(ordered, want, strict=True):
        expected.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, 6), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000)}


def test_one_of_each_component_stays(messy):
    kept = simhash.near_dedup(messy)
    assert kept.columns == messy.columns
    least: dict[int, int] = {}
    for part, (i, _) in zip(brute.near_copies([t for _, t in messy_rows()]), messy_rows(), strict=True):
        key = brute.LAST if i is None else i
        least[part] = min(least.get(part, key), key)
    ids = [brute.LAST if r["doc_id"] is None else r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(least.values())


def test_different_texts_of_null_or_equal_ids_stay(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80)) for i in (None, None, None, 5, 5, 1, 2)]
    copies = [(None, rows[0][1]), (9, rows[3][1]), (None, rows[5][1])]
    kept = simhash.near_dedup(as_documents(spark, rows + copies)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(rows, key=repr)


def test_nothing(nothing):
    assert simhash.report(nothing).count() == 0 and simhash.near_dedup(nothing).count() == 0


def test_columns_of_any_name_are_kept(spark):
    rows = spark.createDataFrame([(1, "a b c", 5, 6, 7, 8, "x"), (2, "d e f", 9, 9, 9, 9, "y")], "doc_id long, text string, _id int, _hash int, _turn int, key int, `x.y` string")
    assert sorted(map(tuple, simhash.near_dedup(rows).collect())) == sorted(map(tuple, rows.collect()))
