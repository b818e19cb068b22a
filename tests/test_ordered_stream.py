from __future__ import annotations

import random
from datetime import timedelta

import pyarrow.parquet as pq
import pytest
from helpers import START, bkt_python
from pyspark.sql import types as T

from edupulse.operators.mastery import BktRule
from edupulse.streaming import ordered_mastery
from edupulse.streaming.keyed_state import KeyedState
from edupulse.streaming.ordered_mastery import OrderedMastery

SCHEMA = T.StructType([
    T.StructField("student_id", T.LongType()), T.StructField("topic_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()), T.StructField("correct", T.BooleanType())])
TABLE = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def plain(batches, delay, flush=True):
    """Per chain the applied rows in the order of their application, and the late rows."""
    mark, waiting, applied, late, seen = None, [], {}, [], set()
    for batch in [*batches, None]:
        if batch is None and not flush:
            break
        for row in batch or ():
            s, t, ts, i, _ = row
            if (s, t, ts, i) in seen:
                continue
            seen.add((s, t, ts, i))
            done = applied.get((s, t))
            (late if done and (ts, i) <= done[-1][:2] else waiting).append(row)
        if batch:
            newest = max(r[2] for r in batch) - delay
            mark = newest if mark is None else max(mark, newest)
        ready = sorted((r for r in waiting if batch is None or r[2] <= mark), key=lambda r: (r[2], r[3]))
        waiting = [r for r in waiting if r not in ready]
        for s, t, ts, i, ok in ready:
            applied.setdefault((s, t), []).append((ts, i, ok))
    return applied, late, waiting


def arrivals(seed, rows=400, batches=5):
    """Attempts that come up to some minutes late, a few far too late, a few twice."""
    rng = random.Random(seed)
    out = [[] for _ in range(batches)]
    for i in range(rows):
        minute = rng.randrange(200)
        row = (rng.randrange(4), rng.choice("ab"), START + timedelta(minutes=minute), i, rng.random() < 0.6)
        at = min(batches - 1, (minute + rng.choice([0, 0, 0, 15, 90])) * batches // 200)
        out[at].append(row)
        if rng.random() < 0.1:
            out[min(batches - 1, at + rng.randrange(2))].append(row)
    return out


def check(keyed, applied, late):
    got = {(r.student_id, r.topic_id): r for r in keyed.states().collect()}
    assert set(got) == set(applied)
    for key, rows in applied.items():
        assert got[key].mastery == pytest.approx(bkt_python([r[2] for r in rows])[1], abs=1e-9)
        assert (got[key].observation_count, got[key].updated_at) == (len(rows), rows[-1][0])
    assert sorted(map(tuple, keyed.late().collect())) == sorted(late)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_are_applied_in_order(spark, tmp_path, seed):
    batches = arrivals(seed)
    keyed = OrderedMastery(spark, str(tmp_path / "s"), SCHEMA, rule=BktRule(), delay_seconds=1200, remember_seconds=1e6, compact_every=3)
    for n, batch in enumerate(batches):
        keyed.apply(spark.createDataFrame(batch, SCHEMA), 2 * n)
        if n == 2:  # a batch that is run again after it was published
            keyed.apply(spark.createDataFrame(batch, SCHEMA), 2 * n)
    applied, late, waiting = plain(batches, timedelta(minutes=20), flush=False)
    assert late and waiting
    check(keyed, applied, late)
    assert sorted(map(tuple, keyed.waiting().collect())) == sorted(waiting)
    keyed.finish()
    applied, late, _ = plain(batches, timedelta(minutes=20))
    check(keyed, applied, late)
    assert keyed.waiting().count() == 0


def test_a_stream_of_files(spark, tmp_path):
    batches = arrivals(5, rows=120, batches=3)
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keyed = OrderedMastery(spark, str(tmp_path / "s"), SCHEMA, rule=BktRule(), delay_seconds=1200, remember_seconds=1e6)
    keyed.start(stream, checkpoint=str(tmp_path / "cp")).awaitTermination()
    keyed.finish()
    applied, late, _ = plain(batches, timedelta(minutes=20))
    check(keyed, applied, late)


def test_keyed_state(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "t"), schema=TABLE, keys=["k"], buckets=4, compact_every=3)
    assert state.read().count() == 0
    want = {}
    for version in range(8):
        rows = [(k, f"{version}") for k in range(version, version + 4)] + ([(None, f"{version}")] if version % 3 == 0 else [])
        want |= dict(rows)
        commit = state.publish(version, spark.createDataFrame(rows, TABLE), {"n": version})
        assert dict(map(tuple, state.read().collect())) == want and commit.extra == {"n": version}
        assert len(commit.deltas) < 3
    some = spark.createDataFrame([(9,), (10,)], "k long")
    found = dict(map(tuple, state.read(of=some).collect()))
    assert {9, 10} <= set(found) and all(want[k] == v for k, v in found.items())
    # Only what the last two versions read is kept.
    kept = {p.name for p in (tmp_path / "t" / "delta").iterdir()} | {p.name for p in (tmp_path / "t" / "base").iterdir()}
    assert "0" not in kept and state.last_commit(before=5).version == 4
    # Nothing is visible before the commit.
    state._write(spark.createDataFrame([(100, "x")], TABLE), "delta", 8)
    assert 100 not in dict(map(tuple, state.read().collect()))


def test_a_commit_names_what_a_version_reads(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "t"), schema=TABLE, keys=["k"])
    for version in (0, 1):
        state.publish(version, spark.createDataFrame([(1, str(version))], state.schema))
    assert [tuple(r) for r in state.read(state.last_commit(before=1)).collect()] == [(1, "0")]
    assert [tuple(r) for r in state.read().collect()] == [(1, "1")]
    plan = state.read()._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan


def in_order(n, rows=40):
    """Batch ``n`` of a stream in order."""
    return [(i % 4, "a", START + timedelta(minutes=n * rows + i), n * rows + i, i % 3 > 0) for i in range(rows)]


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    """However many rows are remembered."""
    keyed = OrderedMastery(spark, str(tmp_path / "s"), SCHEMA, rule=BktRule(), delay_seconds=60, remember_seconds=1e6)
    batches = [in_order(n) for n in range(6)]
    for n, batch in enumerate(batches):
        keyed.apply(spark.createDataFrame(batch, SCHEMA), 2 * n)
    # Of another time, and all of it seen before.
    keyed.apply(spark.createDataFrame(batches[0] + batches[3], SCHEMA), 12)
    keyed.finish()
    check(keyed, *plain(batches, timedelta(minutes=1))[:2])
    written = sum(pq.read_metadata(f).num_rows for f in (tmp_path / "s").rglob("*.parquet") if "state" not in f.relative_to(tmp_path).parts)
    # The last minute of a batch waits and is written again by the next.
    assert written <= 6 * 40 + 8 * 2


@pytest.mark.parametrize("seed", [3, 4])
def test_parts_of_remembered_rows_are_merged(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(ordered_mastery, "_PARTS", 2)
    batches = arrivals(seed, rows=200, batches=6)
    keyed = OrderedMastery(spark, str(tmp_path / "s"), SCHEMA, rule=BktRule(), delay_seconds=1200, remember_seconds=1e6)
    for n, batch in enumerate(batches):
        keyed.apply(spark.createDataFrame(batch + (batches[n - 3][::3] if n >= 3 else []), SCHEMA), 2 * n)
        assert len(keyed.state.last_commit().extra["settled"]) <= 2
    keyed.finish()
    again = [batch + (batches[n - 3][::3] if n >= 3 else []) for n, batch in enumerate(batches)]
    check(keyed, *plain(again, timedelta(minutes=20))[:2])


def test_rows_that_wait_after_a_flush(spark, tmp_path):
    """A flush goes ahead of the watermark, so rows before the flushed ones may wait."""
    keyed = OrderedMastery(spark, str(tmp_path / "s"), SCHEMA, rule=BktRule(), delay_seconds=3600, remember_seconds=1e6)
    first, second, third = [(s, "a", START + timedelta(minutes=m), s, True) for s, m in ((1, 100), (2, 90), (3, 120))]
    keyed.apply(spark.createDataFrame([first], SCHEMA), 0)
    keyed.finish()
    keyed.apply(spark.createDataFrame([second], SCHEMA), 2)
    assert [r.student_id for r in keyed.waiting().collect()] == [2]
    keyed.apply(spark.createDataFrame([third], SCHEMA), 4)
    keyed.apply(spark.createDataFrame([second, second, first], SCHEMA), 6)
    assert sorted(r.student_id for r in keyed.waiting().collect()) == [2, 3]
    keyed.finish()
    check(keyed, {(r[0], "a"): [(r[2], r[3], True)] for r in (first, second, third)}, [])


def test_rows_without_a_student_or_a_time(spark, tmp_path):
    """They make chains like any other; a row without a time comes before all others."""
    keyed = OrderedMastery(spark, str(tmp_path / "s"), SCHEMA, rule=BktRule(), delay_seconds=0, remember_seconds=1e6)
    nobody = [(None, "a", START + timedelta(minutes=m), m, m % 2 == 0) for m in range(4)]
    early, late = (1, "a", None, 7, False), (1, "a", None, 8, False)
    known = (1, "a", START, 9, True)
    keyed.apply(spark.createDataFrame([*nobody[:2], early, known], SCHEMA), 0)
    keyed.apply(spark.createDataFrame([*nobody[2:], late], SCHEMA), 2)
    want = {(None, "a"): [r[2:] for r in nobody], (1, "a"): [early[2:], known[2:]]}
    check(keyed, want, [late])


def test_a_bucket_is_not_a_file_of_every_task(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "t"), schema=TABLE, keys=["k"], buckets=4)
    state.publish(0, spark.range(1000).selectExpr("id AS k", "string(id) AS v").repartition(20))
    assert len(list((tmp_path / "t" / "delta").rglob("*.parquet"))) <= 8
    assert state.read().count() == 1000
