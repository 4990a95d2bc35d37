"""Greedy ensemble weights, their report, and saved ensembles."""

import itertools

import pytest
from pyspark.sql import functions as F

from bidlake.functions.metrics import regression_metrics
from bidlake.models.ensemble import Ensemble, fit_ensemble, greedy_weights, squared_error
from bidlake.models.train import train_regressors
from bidlake.session import stage_path


def test_greedy_weights_are_near_the_best_grid_point():
    matrix = [[4.0, 1.0, -1.0], [1.0, 3.0, 0.5], [-1.0, 0.5, 6.0]]
    got = greedy_weights(matrix, 20)
    assert sum(got) == pytest.approx(1)
    grid = [w for w in itertools.product(range(21), repeat=3) if sum(w) == 20]
    least = min(squared_error(matrix, [x / 20 for x in w]) for w in grid)
    assert squared_error(matrix, got) <= least * 1.02
    assert greedy_weights([[1.0, 2.0], [2.0, 5.0]], 9) == [1.0, 0.0]  # the second never helps
    assert greedy_weights([[2.0]], 3) == [1.0]


@pytest.fixture(scope="module")
def trained(spark):
    rows = spark.range(900).select(
        "id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        F.lit("kept").alias("prediction_note"))
    rows = rows.withColumn("y", F.col("a") * 2 + F.col("b") * F.col("b"))
    train, held = rows.where("id % 3 != 0"), rows.where("id % 3 = 0")
    grid = {"LM": None, "RF": {"numTrees": [3], "maxDepth": [2]}}
    return train_regressors(train, held, ["a", "b"], "y", grid, seed=1), held


def test_report_is_the_metric_of_the_ensembles_own_predictions(spark, trained):
    result, held = trained
    assert len(result.models) == 2
    ensemble, report = fit_ensemble(result.models, held, "y")
    rows = report.orderBy("member").collect()
    assert sum(r["weight"] for r in rows) == pytest.approx(1)
    assert rows[0]["ensemble_r2"] >= max(r["r2"] for r in rows)
    scored = ensemble.transform(held)
    assert scored.columns == [*held.columns, "prediction"]
    r2 = regression_metrics(scored, "y", "prediction").first()["r2"]
    assert r2 == pytest.approx(rows[0]["ensemble_r2"], abs=1e-9)
    again = Ensemble.load(spark, ensemble.save(spark, stage_path(spark, "ensemble")))
    assert again.weights == ensemble.weights
    assert again.transform(held).exceptAll(scored).count() == 0


def test_nothing_to_judge_is_an_error(trained):
    result, held = trained
    with pytest.raises(ValueError, match="validation rows"):
        fit_ensemble(result.models, held.limit(0), "y")
    with pytest.raises(ValueError, match="member"):
        fit_ensemble([], held, "y")
    _, report = fit_ensemble(result.models, held.withColumn("y", F.lit(1.0)), "y")
    assert {r["ensemble_r2"] for r in report.collect()} == {None}
