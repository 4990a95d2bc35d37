"""Boosting that stops on validation rows."""

import pytest
from pyspark.sql import functions as F

from bidlake.models.boosting import fit_classifier, fit_regressor, rounds_used
from bidlake.models.score import load_model, model_features
from bidlake.models.train import save_model, train_classifiers, train_regressors
from bidlake.session import stage_path


@pytest.fixture(scope="module")
def rows(spark):
    """A step of the label at a = 4, in units of a thousandth, with a little noise."""
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1e7
    return spark.range(600).select(
        "id", (F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"),
        ((F.col("id") % 9 >= 4).cast("double") / 1000 + noise).alias("y"),
        ((F.col("id") % 9 >= 4) != (F.col("id") % 11 == 0)).cast("int").alias("c"))


def halves(rows):
    return rows.where("id % 3 != 0"), rows.where("id % 3 = 0")


def test_stops_long_before_the_limit_and_keeps_the_unit(spark, rows):
    train, held = halves(rows)
    model = fit_regressor(train, held, ["a", "b"], "y", 1, {"maxDepth": 1, "stepSize": 0.5})
    assert 1 <= rounds_used(model) <= 20
    out = model.transform(held).agg(F.max(F.abs(F.col("prediction") - F.col("y"))).alias("e"))
    assert out.first()["e"] < 2e-4
    again = load_model(save_model(model, stage_path(spark, "boosted")))
    assert rounds_used(again) == rounds_used(model) and model_features(again) == ["a", "b"]
    first, second = (m.transform(rows).orderBy("id").select("prediction").collect()
                     for m in (model, again))
    assert first == second


def test_best_round_is_kept(rows):
    """A label that is noise on the validation rows: no round after the first helps."""
    train, held = halves(rows)
    model = fit_regressor(train, held.withColumn("y", -F.col("y")), ["a", "b"], "y", 1,
                          {"maxDepth": 1})
    assert rounds_used(model) == 1


def test_constant_label_and_no_validation_rows(rows):
    train, held = halves(rows.withColumn("y", F.lit(5.0)))
    model = fit_regressor(train, held, ["a"], "y", 1, {})
    assert {r["prediction"] for r in model.transform(held).collect()} == {5.0}
    with pytest.raises(ValueError, match="validation rows"):
        fit_regressor(train, train.limit(0), ["a"], "y", 1, {})


@pytest.mark.parametrize("weight", [None, "w"])
def test_classifier_stops_too(rows, weight):
    train, held = halves(rows.withColumn("w", F.lit(2.0)))
    model = fit_classifier(train, held, ["a", "b"], "c", 1, {"maxDepth": 1, "stepSize": 0.5}, weight)
    assert rounds_used(model) < 60
    step = F.col("a") >= 4
    assert model.transform(held).where((F.col("prediction") == 1) != step).count() == 0


def test_rounds_are_reported_for_every_candidate(rows):
    train, held = halves(rows)
    res = train_regressors(train, held, ["a", "b"], "y", {
        "LM": None, "GBM": {"maxDepth": [1], "stepSize": [0.5]}}, seed=1)
    assert res.best_family == "GBM"
    found = {r["family"]: r["rounds"] for r in res.rounds.collect()}
    assert found["LM"] is None and found["GBM"] == rounds_used(res.best)
    res = train_classifiers(train, held, ["a"], "c", {"GBM": {"maxDepth": [1]}}, seed=1)
    assert res.rounds.first()["rounds"] == rounds_used(res.best)
