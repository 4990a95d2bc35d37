import math

from bidlake import catalog
from bidlake.operators.impute import fill_values, impute
from bidlake.operators.split import stratified_sample
from bidlake.plans.weekly import run_weekly, standin_inputs
from bidlake.session import stage_path


def test_impute_mean_and_mode(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (3.0, "b"), (None, "b"), (float("nan"), None), (2.0, "a")],
        "x double, c string")
    vals = fill_values(df, ["x"], ["c"])
    assert vals == {"x": 2.0, "c": "a"}  # tie between a and b: the smallest value
    out = impute(df, ["x"], ["c"]).collect()
    assert all(r.x is not None and not math.isnan(r.x) and r.c is not None for r in out)


def test_stratified_sample_keeps_all_of_a_class(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 10 = 0 AS INT) AS y")
    s = stratified_sample(df, "y", {1: 1.0, 0: 0.1}, seed=3)
    assert s.where("y = 1").count() == 100
    assert 40 < s.where("y = 0").count() < 160


def test_weekly_run_writes_every_output(spark, sf_small):
    paths = run_weekly(spark, standin_inputs(spark, sf_small), stage_path(spark, "weekly"),
                       regressors={"LM": None}, classifiers={"LR": None}, stamp="0101202400")
    vectors = spark.read.parquet(paths["feature_vectors"])
    want = catalog.QUERIES["raw_feature_vectors"](spark, sf_small)
    assert vectors.count() == want.count()
    for name in ("audience", "bid_leaderboard", "bids", "conversions", "conversion_share"):
        assert name in paths
    cm = spark.read.parquet(paths["conversion_test_metrics"]).collect()
    assert {r.cohort for r in cm} <= {"BUILDING", "FURNITURE", "MACHINERY"} and cm
    assert all(r.auc is None or 0.0 <= r.auc <= 1.0 for r in cm)
    share = spark.read.parquet(paths["conversion_share"]).collect()
    assert {r.cohort for r in share} == {"BUILDING", "FURNITURE", "MACHINERY"}
    bids = spark.read.option("header", True).csv(paths["bids"])
    assert bids.count() > 0 and "week" in bids.columns
