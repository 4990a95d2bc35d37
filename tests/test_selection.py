"""Selection without a sort, exact samples, bitmaps of keys, and the metrics on them."""

import hashlib
import random
import statistics

import pytest
from planutil import plan_text
from pyspark.sql import functions as F

from bidlake.functions.metrics import evaluate, pr_curve
from bidlake.operators.bitmap import key_bitmaps, restrict_by_bitmap
from bidlake.operators.selection import kth_smallest, medians
from bidlake.operators.split import exact_sample

SHAPES = {
    "even": lambda r: r.uniform(-1, 1),
    "steep": lambda r: 10.0 ** r.uniform(-200, 200) * r.choice([-1, 1]),
    "few values": lambda r: float(r.choice([0, 0, 0, 1, 7])),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_kth_smallest_equals_a_sort(spark, shape):
    rng = random.Random(5)
    rows = [(g, SHAPES[shape](rng)) for g in ["a"] * 4000 + ["b"] * 7 + [None] * 300]
    df = spark.createDataFrame(rows + [("a", None)], "g string, x double")
    ranks = [("a", 1), ("a", 2000), ("a", 3999), ("a", 4000), ("b", 4), (None, 150), ("b", 8),
             ("c", 1), ("a", 0)]
    got = kth_smallest(df, "x", spark.createDataFrame(ranks, "g string, k int"), ["g"], few=20)
    found = {(r["g"], r["k"]): (r["value"], r["below"]) for r in got.collect()}
    for g, k in ranks[:6]:
        order = sorted(x for h, x in rows if h == g)
        value = order[k - 1]
        assert found.pop((g, k)) == (value, sum(x < value for x in order))
    assert found == {}


def test_long_numbers_that_doubles_cannot_tell_apart(spark):
    rows = [2 ** 60 + k % 5 for k in range(200)] + [2 ** 61]
    df = spark.createDataFrame([(x,) for x in rows], "x bigint")
    ranks = spark.createDataFrame([(1,), (90,), (200,), (201,)], "k int")
    got = {r["k"]: r["value"] for r in kth_smallest(df, "x", ranks, few=10).collect()}
    assert got == {k: sorted(rows)[k - 1] for k in (1, 90, 200, 201)}


def test_medians(spark):
    rows = [("a", float(x)) for x in range(1001)] + [("b", 1.0), ("b", 4.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["median"] for r in medians(df, "x", ["g"], few=10).collect()}
    assert got == {"a": 500.0, "b": 2.5, "c": None}
    assert medians(df, "x", few=10).collect()[0]["median"] == statistics.median(
        x for _, x in rows if x is not None)
    assert medians(df.limit(0), "x").collect()[0]["median"] is None


def test_median_error_is_a_registered_metric(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.5), (3.0, None), (0.0, 4.0)],
                               "y double, p double")
    assert evaluate(df, "median_absolute_error", "y", "p").first()[0] == 1.0


def test_pr_curve(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.05)]
    got = pr_curve(spark.createDataFrame(rows, "y int, s double"), "y", "s").orderBy(
        F.desc("score")).collect()
    assert [(r["score"], r["tp"], r["fp"]) for r in got] == [
        (0.9, 1, 0), (0.8, 2, 1), (0.1, 2, 2), (0.05, 3, 2)]
    assert [r["recall"] for r in got] == [pytest.approx(x / 3) for x in (1, 2, 2, 3)]
    assert [r["precision"] for r in got] == [pytest.approx(x) for x in (1, 2 / 3, 0.5, 0.6)]


def test_exact_sample(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["rare"] + ["common"] * 30 + [None])) for i in range(6000)]
    df = spark.createDataFrame(rows, "id bigint, c string")
    got = exact_sample(df, "c", {"rare": 50, "common": 1000, None: 10_000, "no such": 5}, ["id"],
                       seed=3, few=40)
    assert got.columns == df.columns
    taken = [tuple(r) for r in got.collect()]
    assert len(set(taken)) == len(taken)

    def order(i):
        return hashlib.md5(f"3|={i}".encode()).hexdigest()[:13]

    for c, n in (("rare", 50), ("common", 1000), (None, 10_000)):
        expected = sorted((order(i), i) for i, x in rows if x == c)[:n]
        assert {i for i, x in taken if x == c} == {i for _, i in expected}


def test_exact_sample_of_equal_keys_has_the_exact_size(spark):
    df = spark.createDataFrame([(1, 0)] * 500 + [(2, 0)] * 3, "id int, c int")
    assert exact_sample(df, "c", {0: 100}, ["id"], 1, few=10).count() == 100
    assert exact_sample(df, "c", {0: 0}, ["id"], 1).count() == 0
    assert exact_sample(df.limit(0), "c", {0: 5}, ["id"], 1).collect() == []


def test_bitmap_is_exact_for_any_whole_number(spark):
    rng = random.Random(6)
    keys = sorted({rng.randint(-200_000, 200_000) for _ in range(3000)}
                  | {0, -1, 1, -32768, 32768, 32769, 2 ** 40, -(2 ** 62)})
    probes = sorted(set(keys) | {k + d for k in keys for d in (-1, 1, 8, 32768)})
    log = spark.createDataFrame([(k,) for k in probes] + [(None,)], "ehhn bigint")
    held = spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "ehhn bigint")
    out = restrict_by_bitmap(log, held, "ehhn")
    assert "Exchange hashpartitioning" not in plan_text(out)
    assert sorted(r["ehhn"] for r in out.collect()) == keys
    assert restrict_by_bitmap(log, held.limit(0), "ehhn").count() == 0


def test_nine_million_keys_leave_the_log_where_it_is(spark):
    keys = spark.range(9_000_000).select((F.col("id") * 2).alias("ehhn"))
    log = spark.range(100_000).select((F.col("id") * 7).alias("ehhn"))
    assert key_bitmaps(keys).count() == 551
    out = restrict_by_bitmap(log, keys)
    plan = plan_text(out)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert out.count() == 50_000


def test_text_keys_and_keys_far_apart_take_the_other_way(spark):
    log = spark.range(100).select(F.col("id").cast("string").alias("ehhn"))
    assert restrict_by_bitmap(log, log.limit(0)).count() == 0
    assert restrict_by_bitmap(log, log.where("ehhn < '2'")).count() == 11 + 1
    # one bitmap for each key, beyond the bound: a shuffled semi join
    far = spark.range(2000).select((F.col("id") * 100_000).alias("ehhn"))
    out = restrict_by_bitmap(far, far, max_broadcast_bytes=100_000)
    assert "_bits" not in plan_text(out) and out.count() == 2000
