from __future__ import annotations

import pytest
from helpers import attempts_frame, bkt_python, random_chains

from edupulse.operators.mastery import BktRule, EmaRule, bkt_mastery, bkt_trajectory, ema_mastery


def by_chain(chains):
    out = {}
    for s, seq in chains.items():
        for i, (t, ok) in enumerate(seq):
            out.setdefault((s, t), []).append(ok)
    return out


@pytest.mark.parametrize("max_rows", [None, 60])
def test_final_mastery_matches_recurrence(spark, max_rows):
    chains = random_chains(hot=900)
    got = {(r.student_id, r.topic_id): r for r in bkt_mastery(attempts_frame(spark, chains), max_rows=max_rows).collect()}
    want = by_chain(chains)
    assert set(got) == set(want)
    for key, seq in want.items():
        assert got[key].mastery == pytest.approx(bkt_python(seq)[1], abs=1e-9)
        assert got[key].observation_count == len(seq)


@pytest.mark.parametrize("max_rows", [None, 60])
def test_trajectory_matches_recurrence(spark, max_rows):
    chains = random_chains(hot=900)
    df = attempts_frame(spark, chains)
    rows = bkt_trajectory(df, max_rows=max_rows).orderBy("student_id", "topic_id", "ts").collect()
    assert len(rows) == df.count()
    got = {}
    for r in rows:
        got.setdefault((r.student_id, r.topic_id), []).append(r)
    for key, seq in by_chain(chains).items():
        assert [r.correct for r in got[key]] == seq
        assert [r.mastery_before for r in got[key]] == pytest.approx(bkt_python(seq)[0], abs=1e-9)
        assert got[key][0].predicted == pytest.approx(0.5639 * (1 - 0.187) + (1 - 0.5639) * 0.3521)


def test_ema_and_hot_ema(spark):
    chains = random_chains(students=3, hot=300)
    want = {}
    for key, seq in by_chain(chains).items():
        m = 0.5
        for ok in seq:
            m += 0.3 * ((1.0 if ok else 0.0) - m)
        want[key] = m
    for max_rows in (None, 40):
        got = {(r.student_id, r.topic_id): r.mastery for r in ema_mastery(attempts_frame(spark, chains), max_rows=max_rows).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_twenty_correct_converge(spark):
    row = bkt_mastery(attempts_frame(spark, {1: [("a", True)] * 20}), params=BktRule(prior=0.3)).first()
    assert 0.95 < row.mastery <= 1.0


def test_parameter_domains():
    for bad in (dict(prior=1.1), dict(transit=-0.1), dict(slip=0.0), dict(guess=1.0)):
        with pytest.raises(ValueError):
            BktRule(**bad)
    for bad in (dict(rate=0.0), dict(rate=1.5), dict(initial=-1.0)):
        with pytest.raises(ValueError):
            EmaRule(**bad)


def test_many_hot_keys_are_not_broadcast(spark, monkeypatch):
    from edupulse.operators import skew

    monkeypatch.setattr(skew, "MAX_BROADCAST_ROWS", 1)
    chains = random_chains(hot=300)
    df = attempts_frame(spark, chains)
    got = {(r.student_id, r.topic_id): r.mastery for r in bkt_mastery(df, max_rows=40).collect()}
    assert got == pytest.approx({k: bkt_python(seq)[1] for k, seq in by_chain(chains).items()}, abs=1e-9)
