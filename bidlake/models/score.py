"""Batch scoring.

``PipelineModel.transform`` runs on the executors partition by partition; the output
keeps only the key (and cohort) plus the prediction, so nothing but the result is
written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BID_COLUMN, CONVERSION_COLUMN, KEY
from .train import PREDICTION, PROBABILITY


class MissingFeatureError(ValueError):
    pass


def load_model(path: str) -> PipelineModel:
    """Load a saved pipeline (with the active session)."""
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    """M8: the feature columns the model expects, in order."""
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return list(stage.getInputCols())
    raise ValueError("pipeline has no VectorAssembler stage")


def check_features(df: DataFrame, model: PipelineModel) -> None:
    missing = [c for c in model_features(model) if c not in df.columns]
    if missing:
        raise MissingFeatureError(f"scoring frame lacks model features {missing}")


def score_regression(model: PipelineModel, df: DataFrame, key: str = KEY,
                     out_col: str = BID_COLUMN, keep: Sequence[str] = ()) -> DataFrame:
    """M5 + P14: ``(key, *keep, basebid)``."""
    check_features(df, model)
    return model.transform(df).select(key, *keep, F.col(PREDICTION).alias(out_col))


def score_probability(model: PipelineModel, df: DataFrame, key: str = KEY,
                      out_col: str = CONVERSION_COLUMN, keep: Sequence[str] = ("cohort",)
                      ) -> DataFrame:
    """M6 + P15 (+ M9 when ``df`` holds several cohorts): ``(key, *keep, P(class 1))``."""
    check_features(df, model)
    out = model.transform(df)
    return out.select(key, *keep, vector_to_array(PROBABILITY)[1].alias(out_col))
