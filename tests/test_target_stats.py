"""Ordered target statistics against a plain version, and their plan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bidlake.models.score import model_features
from bidlake.operators.target_stats import fit_target_statistics, ordered_target_statistics
from bidlake.plans import training

SCHEMA = "id bigint, a string, b int, y double"


def plain(rows, column, seed, weight=1.0):
    labels = [r[3] for r in rows if r[3] is not None]
    prior = sum(labels) / len(labels)
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}|={r[0]}".encode()).hexdigest(), r[0]))
    sums, out = {}, {}
    for r in order:
        s, n = sums.get(r[column], (0.0, 0))
        out[r[0]] = (s + weight * prior) / (n + weight)
        if r[3] is not None:
            sums[r[column]] = (s + r[3], n + 1)
    return out, {c: (s + weight * prior) / (n + weight) for c, (s, n) in sums.items()}, prior


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    # half of the rows share a category, and some have none
    return [(i, rng.choice(["hot"] * 6 + ["x", "y", "z", None, None]), rng.randint(0, 3),
             None if i % 17 == 0 else float(rng.randint(0, 100))) for i in range(500)]


@pytest.mark.parametrize("weight", [1.0, 5.0])
def test_ordered_values_and_full_values(spark, rows, weight):
    df = spark.createDataFrame(rows, SCHEMA)
    out, stats = ordered_target_statistics(df, ["a", "b"], "y", "id", seed=3, weight=weight)
    assert out.columns == ["id", "a", "b", "y", "a_ts", "b_ts"]
    got = {r["id"]: (r["a_ts"], r["b_ts"]) for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    for k, column in enumerate((1, 2)):
        ordered, full, prior = plain(rows, column, 3, weight)
        assert {i: pytest.approx(v) for i, v in ordered.items()} == {i: g[k] for i, g in got.items()}
        name = "ab"[k]
        seen = {r[name]: r[f"{name}_ts"] for r in stats.transform(df).collect()}
        assert {c: pytest.approx(v) for c, v in full.items()} == seen
    assert stats.prior == pytest.approx(prior)


def test_a_row_never_sees_its_own_label(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    stats = fit_target_statistics(df, ["a"], "y")
    one, _ = ordered_target_statistics(df, ["a"], "y", "id", 3, fitted=stats)
    other, _ = ordered_target_statistics(
        df.withColumn("y", F.when(F.col("id") == 8, 1e6).otherwise(F.col("y"))), ["a"], "y", "id",
        3, fitted=stats)
    value = [f.where("id = 8").first()["a_ts"] for f in (one, other)]
    assert value[0] == value[1]


def test_unseen_null_and_empty(spark, rows):
    known = spark.createDataFrame([r for r in rows if r[1] in ("x", "y")], SCHEMA)
    stats = fit_target_statistics(known, ["a"], "y")
    new = spark.createDataFrame([(1, "new", 0, None), (2, None, 0, None)], SCHEMA)
    assert [r["a_ts"] for r in stats.transform(new).collect()] == [pytest.approx(stats.prior)] * 2
    none = known.limit(0)
    out, stats = ordered_target_statistics(none, ["a"], "y", "id", 3)
    assert out.collect() == [] and stats.prior == 0.0
    with pytest.raises(ValueError, match="weight"):
        fit_target_statistics(known, ["a"], "y", weight=0)


def test_hot_category_is_cut_over_partitions(spark):
    """All rows in one category: the window runs over range partitions, not over the category."""
    df = spark.range(4000).select("id", F.lit("hot").alias("a"), F.lit(1).alias("b"),
                                  (F.col("id") % 5).cast("double").alias("y"))
    out, _ = ordered_target_statistics(df, ["a"], "y", "id", 3, partitions=8)
    staged = spark.read.parquet(*[f for f in out.inputFiles() if "running-totals" in f])
    parts = staged.groupBy("_seq_part").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 1500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_boosting_over_statistics_is_a_family(spark):
    """A label that only a category's identity explains, over more categories than a few splits of
    ordinal codes tell apart."""
    rows = spark.range(3000).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(60)).cast("string").alias("site"),
        F.lit(0).alias("hour")).withColumn(
        "MediaCostInBucks", F.pmod(F.xxhash64("site"), F.lit(7)).cast("double"))
    prepared, enc, stats = training.prepare_with_statistics(rows, ["site"], "id", 1)
    assert "id" not in prepared.columns and prepared.count() == 3000
    bt = training.train_bid_model(
        spark, "", {"GBM": {"maxDepth": [2], "maxIter": [3]}, "CAT": {"maxDepth": [2], "maxIter": [3]}},
        prepared=prepared, encoding=enc, feature_cols=("site", "hour"),
        feature_sets={"CAT": ("site_ts", "hour")})
    board = {r["family"]: r["score"] for r in bt.result.leaderboard.collect()}
    assert bt.result.best_family == "CAT" and board["CAT"] > board["GBM"] + 0.1
    assert model_features(bt.result.best) == ["site_ts", "hour"]
    # scoring: encode, then look up the statistics
    new = stats.transform(enc.transform(rows.limit(50)))
    assert bt.result.best.transform(new).where(F.col("prediction").isNull()).count() == 0
