import pytest
from pyspark.sql import functions as F

from bidlake.models.score import MissingFeatureError, load_model, model_features, score_probability
from bidlake.models.train import save_model, train_classifiers, train_regressors
from bidlake.session import stage_path


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(400).select(
        F.col("id").alias("ehhn"),
        (F.col("id") % 7).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        F.lit("A").alias("cohort"),
    )
    return (df.withColumn("y", F.col("a") * 2 + F.col("b"))
              .withColumn("c", (F.col("a") > 3).cast("int")))


def test_regressor_champion_is_best(spark, frame):
    train, val = frame.where("ehhn % 5 != 0"), frame.where("ehhn % 5 = 0")
    res = train_regressors(train, val, ["a", "b"], "y",
                           {"LM": None, "RF": {"numTrees": [5], "maxDepth": [3]}}, seed=1)
    board = res.leaderboard.collect()
    best = max(board, key=lambda r: r.score)
    assert best.is_champion and best.family == res.best_family
    assert sum(r.is_champion for r in board) == 1
    assert res.best_score > 0.99  # a linear target


def test_classifier_probabilities_and_contract(spark, frame):
    train, val = frame.where("ehhn % 5 != 0"), frame.where("ehhn % 5 = 0")
    res = train_classifiers(train, val, ["a", "b"], "c", {"LR": None}, seed=1)
    path = save_model(res.best, stage_path(spark, "model-test"))
    model = load_model(path)
    assert model_features(model) == ["a", "b"]
    out = score_probability(model, frame).collect()
    assert len(out) == 400 and all(0.0 <= r.sales_conversion <= 1.0 for r in out)
    with pytest.raises(MissingFeatureError, match="'b'"):
        score_probability(model, frame.drop("b"))
