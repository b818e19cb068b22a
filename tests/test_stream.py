from __future__ import annotations

import pytest
from helpers import ATTEMPT_SCHEMA, attempts_frame, bkt_python, random_chains

from edupulse.operators.advance import advance_mastery
from edupulse.operators.mastery import CHAIN_KEYS, BktRule, EmaRule, final_mastery
from edupulse.streaming.mastery_stream import MasteryProcessor, mastery_stream
from edupulse.streaming.sinks import advance_sink, append_changes, compact, read_upserted, upsert_sink

KEYS = list(CHAIN_KEYS)


def write_in_order(df, path, batches):
    """One file per batch of events; one file per micro-batch when read."""
    total = df.count()
    ids = [r.event_id for r in df.orderBy("ts", "event_id").collect()]
    for i in range(batches):
        part = ids[i * total // batches : (i + 1) * total // batches]
        df.where(df.event_id.isin(part)).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(ATTEMPT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, tmp_path, stream, **kwargs):
    upsert_sink(stream, str(tmp_path / "out"), keys=KEYS, order_by=["observation_count"], checkpoint=str(tmp_path / "cp"),
                where="kind = 'state'", side_path=str(tmp_path / "late"), **kwargs).awaitTermination()
    late = spark.read.parquet(str(tmp_path / "late"))
    return {(r.student_id, r.topic_id): r for r in read_upserted(spark, str(tmp_path / "out"), keys=KEYS).collect()}, late


@pytest.mark.parametrize("rule", [BktRule(), EmaRule()])
def test_stream_equals_batch(spark, tmp_path, rule):
    df = attempts_frame(spark, random_chains(students=4, length=30))
    write_in_order(df, str(tmp_path / "in"), 3)
    got, late = run(spark, tmp_path, mastery_stream(source(spark, str(tmp_path / "in")), rule=rule))
    want = {(r.student_id, r.topic_id): r for r in final_mastery(df, rule).collect()}
    assert set(got) == set(want) and late.count() == 0
    for key, row in want.items():
        assert got[key].mastery == pytest.approx(row.mastery, abs=1e-9)
        assert (got[key].observation_count, got[key].updated_at) == (row.observation_count, row.updated_at)


def test_late_rows_go_to_the_side(spark, tmp_path):
    df = attempts_frame(spark, {1: [("a", ok) for ok in (True, False, True, True, False)]})
    for part in ("event_id in (0, 1, 3)", "event_id in (2, 4)"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, late = run(spark, tmp_path, mastery_stream(source(spark, str(tmp_path / "in")), rule=BktRule()))
    assert [r.event_id for r in late.collect()] == [2]
    assert got[(1, "a")].observation_count == 4
    assert got[(1, "a")].mastery == pytest.approx(bkt_python([True, False, True, False])[1])


def test_delay_reorders(spark, tmp_path):
    outcomes = [True, False, True, True, False, True, False]
    df = attempts_frame(spark, {1: [("a", ok) for ok in outcomes]})
    for part in ("event_id in (0, 1, 3)", "event_id in (2, 4)", "event_id in (5, 6)"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = mastery_stream(source(spark, str(tmp_path / "in")), rule=BktRule(), delay_seconds=120)
    got, late = run(spark, tmp_path, stream)
    # Rows at least two minutes older than the newest are applied; the rest still wait.
    assert late.count() == 0 and got[(1, "a")].observation_count == 5
    assert got[(1, "a")].mastery == pytest.approx(bkt_python(outcomes[:5])[1])


@pytest.mark.parametrize("max_rows", [None, 20])
def test_advance_equals_one_fold(spark, max_rows):
    df = attempts_frame(spark, random_chains(students=3, length=20, hot=200))
    cut = df.selectExpr("percentile_approx(ts, 0.5)").first()[0]
    old, new = df.where(df.ts <= cut), df.where(df.ts > cut)
    before = final_mastery(old, BktRule())
    got = {(r.student_id, r.topic_id): r for r in advance_mastery(before, new, BktRule(), max_rows=max_rows).collect()}
    want = {(r.student_id, r.topic_id): r for r in final_mastery(df, BktRule()).collect()}
    touched = {(r.student_id, r.topic_id) for r in new.select(*KEYS).distinct().collect()}
    assert set(got) == touched
    for key in touched:
        assert got[key].mastery == pytest.approx(want[key].mastery, abs=1e-9)
        assert (got[key].observation_count, got[key].updated_at) == (want[key].observation_count, want[key].updated_at)


def test_advance_sink(spark, tmp_path):
    df = attempts_frame(spark, random_chains(students=4, length=30))
    write_in_order(df, str(tmp_path / "in"), 3)
    advance_sink(source(spark, str(tmp_path / "in")), str(tmp_path / "out"), rule=BktRule(), checkpoint=str(tmp_path / "cp")).awaitTermination()
    got = {(r.student_id, r.topic_id): r.mastery for r in read_upserted(spark, str(tmp_path / "out"), keys=KEYS).collect()}
    assert got == pytest.approx({(r.student_id, r.topic_id): r.mastery for r in final_mastery(df, BktRule()).collect()})


def test_replayed_batch_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, n long")
    two = spark.createDataFrame([(1, "d", 3)], one.schema)
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        append_changes(batch, number, path, ["k"], ["n"])
    rows = {(r.k, r.v, r.n) for r in read_upserted(spark, path, keys=["k"]).collect()}
    assert rows == {(1, "d", 3), (2, "c", 1)}
    compact(spark, path, str(tmp_path / "t2"), keys=["k"])
    assert {(r.k, r.v, r.n) for r in read_upserted(spark, str(tmp_path / "t2"), keys=["k"]).collect()} == rows


def test_a_chain_costs_one_read_and_one_write_of_state():
    class Value:
        calls, held = [], None

        def __getattr__(self, name):
            self.calls.append(name)
            return {"get": lambda: self.held, "exists": lambda: self.held is not None, "update": lambda v: setattr(self, "held", v),
                    "clear": lambda: None}[name]

    class Handle:
        def getValueState(self, *_):
            return Value()

        getListState = getValueState

    rule = BktRule()
    processor = MasteryProcessor({ok: tuple(map(float, rule.matrix(ok))) for ok in (True, False)}, rule.initial, 0, None)
    processor.init(Handle())
    outcomes = [True, False, True]
    for at in range(0, 3, 2):
        rows = [{"us": i, "event_id": i, "correct": ok} for i, ok in enumerate(outcomes)][at: at + 2]
        out = list(processor.handleInputRows((1, "a"), iter(rows), None))
    assert Value.calls == ["get", "update"] * 2
    assert [(r.kind, r.observation_count, r.us) for r in out] == [("state", 3, 2)]
    assert out[0].mastery == pytest.approx(bkt_python(outcomes)[1])
