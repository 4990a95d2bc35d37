import math

import pytest
from planutil import plan_text
from pyspark.sql import Row
from pyspark.sql import functions as F

from bidlake.operators.latest import latest_per_key
from bidlake.operators.relational import (
    FanOutError,
    audience,
    drop_incomplete,
    exclude_columns,
    join_on_key,
    key_coverage,
    rename_columns,
    restrict_to_keys,
    union_logs,
)


def test_intersect_keeps_null_key_once(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "ehhn bigint")
    b = spark.createDataFrame([(1,), (None,)], "ehhn bigint")
    got = sorted(audience(a, b).collect(), key=lambda r: (r.ehhn is None, r.ehhn))
    assert [r.ehhn for r in got] == [1, None]


def test_inner_join_null_keys_never_match(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "ehhn bigint, x string")
    b = spark.createDataFrame([(1, 10.0), (None, 20.0)], "ehhn bigint, y double")
    got = join_on_key(a, b).collect()
    assert len(got) == 2 and all(r.ehhn == 1 for r in got)


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "p int, q string")
    b = spark.createDataFrame([("y", 2)], "q string, p int")
    got = sorted(union_logs([a, b]).collect())
    assert got == [Row(p=1, q="x"), Row(p=2, q="y")]


def test_latest_tie_on_time_takes_greatest_tiebreaker(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2)], "k int, t int, id int")
    assert latest_per_key(df, "k", "t", "id").collect()[0].id == 2


def test_latest_null_time_sorts_last(spark):
    df = spark.createDataFrame([(1, None, 9), (1, 5, 1)], "k int, t int, id int")
    assert latest_per_key(df, "k", "t", "id").collect()[0].id == 1


def test_latest_plan_limits_before_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t")
    plan = plan_text(latest_per_key(df, "k", "t"))
    assert plan.count("WindowGroupLimit") >= 2


def test_fanout_policies(spark):
    left = spark.createDataFrame([(1, "a")], "ehhn bigint, x string")
    right = spark.createDataFrame([(1, 1, 10.0), (1, 2, 11.0), (1, 3, 12.0)],
                                  "ehhn bigint, t int, y double")
    assert join_on_key(left, right).count() == 3
    with pytest.raises(FanOutError):
        join_on_key(left, right, on_duplicate="error")
    got = join_on_key(left, right, on_duplicate="latest", order_by=["t"]).collect()
    assert len(got) == 1 and got[0].y == 12.0


def test_join_refuses_duplicate_column_names(spark):
    left = spark.createDataFrame([(1, "a")], "ehhn bigint, x string")
    right = spark.createDataFrame([(1, "b")], "ehhn bigint, x string")
    with pytest.raises(ValueError):
        join_on_key(left, right)


def test_drop_incomplete_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)],
                               "v double, s string")
    assert drop_incomplete(df).collect() == [Row(v=1.0, s="a")]


def test_rename_missing_column_raises(spark):
    df = spark.createDataFrame([(1,)], "HSHD_CODE bigint")
    assert rename_columns(df, {"HSHD_CODE": "ehhn"}).columns == ["ehhn"]
    with pytest.raises(ValueError):
        rename_columns(df, {"nope": "x"})


def test_exclude_columns_ignores_absent_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ehhn int, a int, emb int")
    assert exclude_columns(df, ["ehhn", "emb", "missing", "ehhn"]).columns == ["a"]


def test_restrict_semi_join_no_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "ehhn bigint, x string")
    keys = spark.createDataFrame([(1,), (1,)], "ehhn bigint")
    assert restrict_to_keys(df, keys).collect() == [Row(ehhn=1, x="a")]
    # The shuffled fallback (no broadcast) gives the same rows.
    assert restrict_to_keys(df, keys, max_broadcast_bytes=0).collect() == [Row(ehhn=1, x="a")]


def test_key_coverage_counts(spark):
    base = spark.createDataFrame([(1,), (2,), (2,), (None,)], "ehhn bigint")
    other = spark.createDataFrame([(2,), (3,), (None,)], "ehhn bigint")
    got = key_coverage(base, {"o": other}).collect()[0]
    assert (got.base_keys, got.source_keys, got.shared_keys) == (3, 3, 2)
    assert not math.isnan(got.shared_keys)


def test_large_audience_path_limits_before_its_only_log_shuffle(spark):
    from bidlake.operators.latest import latest_within_keys

    # One hot key holds a third of the rows.
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS ehhn",
                                      "id AS t")
    keys = spark.range(0, 3000, 7).selectExpr("id AS ehhn")
    out = latest_within_keys(df, keys, "ehhn", "t", max_broadcast_bytes=0)
    plan = plan_text(out, "simple")
    assert plan.count("WindowGroupLimit") >= 2 and "LeftSemi" in plan
    assert plan.index("LeftSemi") < plan.index("Window [")  # semi join above the window
    got = {r.ehhn: r.t for r in out.collect()}
    assert got[7] == 2999 - (2999 % 3)


def test_maybe_broadcast_decision(spark):
    from planutil import plan_text as _pt

    from bidlake.operators.broadcast import maybe_broadcast

    small = spark.range(5).withColumnRenamed("id", "ehhn")
    big_bound = spark.range(100)
    b, ok = maybe_broadcast(small, max_bytes=1000)
    assert ok and "broadcast" in _pt(spark.range(3).withColumnRenamed("id", "ehhn")
                                     .join(b, "ehhn"), "simple").lower()
    assert maybe_broadcast(small, max_bytes=1000, bound=big_bound)[1] is False
    assert maybe_broadcast(small, max_bytes=0)[1] is False
    spark.conf.set("bidlake.broadcast.maxBytes", "100")
    try:
        assert maybe_broadcast(small)[1] is False
    finally:
        spark.conf.unset("bidlake.broadcast.maxBytes")


def test_broadcast_counts_bytes_not_rows(spark):
    from bidlake.operators.broadcast import maybe_broadcast, parse_bytes

    wide = spark.range(50).selectExpr("id AS ehhn", "repeat('x', 1000) AS t")
    assert maybe_broadcast(wide.select("ehhn"), max_bytes=10_000)[1] is True
    assert maybe_broadcast(wide, max_bytes=10_000)[1] is False
    nine_million = spark.range(9_000_000).selectExpr("concat('household-', id) AS ehhn")
    assert maybe_broadcast(nine_million)[1] is False
    assert [parse_bytes(x) for x in ("10485760b", "256k", "1gb", "-1")] == [
        10485760, 262144, 1 << 30, -1]


def test_latest_join_honours_every_order_column(spark):
    left = spark.createDataFrame([(1, "a")], "ehhn bigint, x string")
    right = spark.createDataFrame(
        [(1, 5, 1, 1), (1, 5, 9, 2), (1, 5, 9, 3), (1, 4, 99, 4), (1, None, 100, 5)],
        "ehhn bigint, d int, h int, id int")
    for rows in (right, right.orderBy(F.desc("id"))):
        got = join_on_key(left, rows, on_duplicate="latest", order_by=["d", "h"],
                          tie_breaker="id").collect()
        assert [(r.d, r.h, r.id) for r in got] == [(5, 9, 3)]


def test_latest_policy_needs_an_order(spark):
    left = spark.createDataFrame([(1, "a")], "ehhn bigint, x string")
    right = spark.createDataFrame([(1, 1.0)], "ehhn bigint, y double")
    with pytest.raises(ValueError):
        join_on_key(left, right, on_duplicate="latest")
    with pytest.raises(ValueError):
        join_on_key(left, right, on_duplicate="nope")
