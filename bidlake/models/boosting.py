"""Gradient boosting that stops on validation rows (M1 GBM, M3, M7).

Training and validation rows are one labelled frame with an indicator column. After every round
MLlib measures the loss on the indicated rows; a round that lowers it by less than ``validationTol``
of the loss ends the boosting, and the model keeps the trees up to the best round. So the number
of rounds asked for (10 000 by default) is a limit, not the work done.

MLlib compares a round's gain with ``validationTol * max(loss, 0.01)``. That floor would end the
boosting of a label of small numbers at once (a bid's squared error is about 1e-7). So the
regressor boosts the standardised label (mean and deviation of the training rows, one aggregate),
where a loss of 1 is the label's variance whatever its unit, and the pipeline's last stage turns
predictions back. It is saved and loaded with the model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "features"
PREDICTION = "prediction"
HELD_OUT = "_held_out"
SCALED_LABEL = "_scaled_label"
SCALED_PREDICTION = "_scaled_prediction"

#: Rounds at most (the reference's size).
MAX_ROUNDS = 10_000
#: A round has to lower the validation loss by this share of it. (The log loss of classes that
#: trees tell apart sinks for ever, ever slower, so classifiers ask for more.)
VALIDATION_TOL = 1e-4
CLASSIFIER_TOL = 1e-3


def _tree_params(p: Mapping, tol: float) -> dict:
    return {"maxIter": p.get("maxIter", MAX_ROUNDS), "maxDepth": p.get("maxDepth", 5),
            "maxBins": p.get("maxBins", 128), "stepSize": p.get("stepSize", 0.1),
            "validationIndicatorCol": HELD_OUT,
            "validationTol": p.get("validationTol", tol)}


def _assembler(feature_cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(feature_cols), outputCol=FEATURES,
                           handleInvalid="keep")


def _labelled(train: DataFrame, validation: DataFrame, columns: Sequence[str]) -> DataFrame:
    if validation.isEmpty():
        raise ValueError("boosting needs validation rows to stop on")
    return train.select(*columns, F.lit(False).alias(HELD_OUT)).unionByName(
        validation.select(*columns, F.lit(True).alias(HELD_OUT)))


def fit_regressor(train: DataFrame, validation: DataFrame, feature_cols: Sequence[str],
                  label: str, seed: int, p: Mapping) -> PipelineModel:
    """Boosted regression trees. A constant label is only shifted; without validation rows there
    is nothing to stop on, which is an error."""
    mean, deviation = train.agg(F.avg(label), F.stddev_pop(label)).first()
    mean, deviation = mean or 0.0, deviation or 1.0
    rows = _labelled(train, validation, [*feature_cols, label]).withColumn(
        SCALED_LABEL, (F.col(label) - F.lit(mean)) / F.lit(deviation))
    trees = GBTRegressor(labelCol=SCALED_LABEL, featuresCol=FEATURES, seed=seed,
                         predictionCol=SCALED_PREDICTION, **_tree_params(p, VALIDATION_TOL))
    back = SQLTransformer(statement=(
        f"SELECT *, {SCALED_PREDICTION} * {deviation!r}D + {mean!r}D AS {PREDICTION} "
        "FROM __THIS__"))
    return Pipeline(stages=[_assembler(feature_cols), trees, back]).fit(rows)


def fit_classifier(train: DataFrame, validation: DataFrame, feature_cols: Sequence[str],
                   label: str, seed: int, p: Mapping, weight_col: str | None) -> PipelineModel:
    """Boosted classification trees; the log loss of the validation rows decides."""
    trees = GBTClassifier(labelCol=label, featuresCol=FEATURES, seed=seed,
                          **_tree_params(p, CLASSIFIER_TOL))
    columns = [*feature_cols, label]
    if weight_col is not None:
        trees = trees.setWeightCol(weight_col)
        columns.append(weight_col)
    return Pipeline(stages=[_assembler(feature_cols), trees]).fit(
        _labelled(train, validation, columns))


def rounds_used(model: PipelineModel) -> int | None:
    """Rounds that the model keeps; None if it isn't a boosted one."""
    for stage in model.stages:
        if isinstance(stage, (GBTRegressionModel, GBTClassificationModel)):
            return stage.getNumTrees
    return None
