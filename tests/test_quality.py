from __future__ import annotations

import pytest

from edupulse.operators import quality as q


def frame(spark, rows, ddl="k long, v string"):
    return spark.createDataFrame(rows, ddl)


def bad(check):
    row = check.first()
    return row.n_bad, row.n_rows


def test_unique_counts_whole_groups(spark):
    assert bad(q.check_unique(frame(spark, [(1, "a"), (1, "b"), (2, "c")]), ["k"], table="t")) == (2, 3)
    assert bad(q.check_unique(frame(spark, [(1, "a"), (2, "c")]), ["k"], table="t")) == (0, 2)
    assert bad(q.check_unique(frame(spark, []), ["k"], table="t")) == (0, 0)


def test_duplicates(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (1, "a"), (1, None), (1, None), (2, "a")])
    assert bad(q.check_duplicates(df, table="t")) == (5, 6)


def test_row_count(spark):
    three, two = frame(spark, [(1, "a")] * 3), frame(spark, [(1, "a")] * 2)
    assert bad(q.check_row_count(three, two, table="t"))[0] == 1
    assert bad(q.check_row_count(two, two, table="t"))[0] == 0


def test_foreign_key_matches_null_with_null(spark):
    child = frame(spark, [(1, "a"), (1, "b"), (3, "c"), (3, "c"), (None, "d")])
    parent = frame(spark, [(1, "x"), (2, "y")])
    assert bad(q.check_foreign_key(child, parent, ["k"], table="t")) == (2, 3)
    with_null = parent.unionByName(frame(spark, [(None, "z")]))
    assert bad(q.check_foreign_key(child, with_null, ["k"], table="t")) == (1, 3)
    row = q.check_foreign_key_rows(child, with_null, ["k"], table="t").first()
    assert (row.n_bad, row.n_rows, row.n_bad_keys) == (2, 5, 1)


def test_allowed_counts_null(spark):
    df = frame(spark, [(1, "a"), (2, "b"), (3, None)])
    assert bad(q.check_allowed(df, "v", ["a"], table="t")) == (2, 3)


def test_range_skips_null_and_open_bounds(spark):
    df = frame(spark, [(-1, "a"), (5, "a"), (99, "a"), (None, "a")])
    assert bad(q.check_range(df, "k", 0, 50, table="t"))[0] == 2
    assert bad(q.check_range(df, "k", 0, None, table="t"))[0] == 1
    assert bad(q.check_range(df, "k", -1, 99, table="t"))[0] == 0


def test_nulls(spark):
    assert bad(q.check_nulls(frame(spark, [(1, None), (None, None), (1, "a")]), table="t")) == (2, 3)


def test_columns(spark):
    df = frame(spark, [(1, "a")])
    assert q.check_columns(df, ["v", "k"], table="t")
    with pytest.raises(q.QualityError, match="missing \\['w'\\], unexpected \\['v'\\]"):
        q.check_columns(df, ["k", "w"], table="t")
    with pytest.raises(q.QualityError):
        q.require_columns(df, ["w"], table="t")
    q.require_columns(df, ["k"], table="t")


def test_identity(spark):
    df = frame(spark, [(3, 1, 2), (4, 1, 2)], "total long, a long, b long")
    assert bad(q.check_identity(df, "total", ["a", "b"], table="t")) == (1, 2)


def test_unseen_values(spark):
    df = frame(spark, [(1, "a"), (2, "z"), (3, "z")])
    assert [r.v for r in q.unseen_values(df, "v", ["a"]).collect()] == ["z"]


def test_two_hop(spark):
    child = frame(spark, [(1, 7), (2, 7), (9, 7)], "aid long, sid long")
    bridge = frame(spark, [(1, "m"), (2, "n")], "aid long, course string")
    parent = frame(spark, [("m", 7)], "course string, sid long")
    assert bad(q.check_two_hop(child, bridge, parent, bridge_key="aid", parent_keys=["course", "sid"], table="t"))[0] == 2


def test_one_to_one(spark):
    a, b = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(1, "x"), (2, "y"), (2, "z"), (3, "w")])
    assert bad(q.check_one_to_one(a, b, ["k"], table="t")) == (2, 3)
    assert bad(q.check_one_to_one(a, a, ["k"], table="t"))[0] == 0


def test_enforce_and_report(spark):
    good = q.check_nulls(frame(spark, [(1, "a")]), table="t")
    broken = q.check_nulls(frame(spark, [(1, None)]), table="t")
    assert len(q.enforce([good])) == 1
    assert [r.n_bad for r in q.report([good, broken])] == [0, 1]
    with pytest.raises(q.QualityError, match="t: nulls failed for 1 of 1"):
        q.enforce([good, broken])
