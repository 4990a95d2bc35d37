"""Model training with MLlib (M1-M3, M7, K5, M8).

Several model families are fitted on the training split, each scored on the validation
split with the registered metric, and the best kept ("champion"). Fits run on the
executors (MLlib trees and linear models are distributed); the driver only holds model
metadata and one metric row per candidate.

Boosting (``GBM``) stops on the validation rows (``boosting.py``), so its 10 000 rounds are a
limit; ``TrainingResult.rounds`` has the rounds that each candidate kept.

The feature contract (M8) is the VectorAssembler's input columns, saved inside the
pipeline: scoring reads it back from the loaded model and fails clearly on a missing
column.
"""

from __future__ import annotations

import itertools
import json
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, evaluate
from . import boosting
from .boosting import FEATURES, PREDICTION

PROBABILITY = "probability"
P_CLASS1 = "p1"
CANDIDATE = "_candidate"

# Defaults are the reference's sizes: 100 forest trees, at most 10 000 boosting rounds. Callers
# that want less pass a grid.
#: Boosted trees: on the feature columns, and on target statistics of the categoricals
#: (``operators/target_stats.py``; name its columns in ``feature_sets``).
BOOSTED = ("GBM", "CAT")
REGRESSOR_FAMILIES = {
    "RF": lambda label, seed, p: RandomForestRegressor(
        labelCol=label, featuresCol=FEATURES, seed=seed,
        numTrees=p.get("numTrees", 100), maxDepth=p.get("maxDepth", 6),
        maxBins=p.get("maxBins", 128), subsamplingRate=p.get("subsamplingRate", 1.0),
        bootstrap=p.get("bootstrap", True),
        featureSubsetStrategy=p.get("featureSubsetStrategy", "auto")),
    "LM": lambda label, seed, p: LinearRegression(
        labelCol=label, featuresCol=FEATURES,
        regParam=p.get("regParam", 0.0), elasticNetParam=p.get("elasticNetParam", 0.0)),
}

CLASSIFIER_FAMILIES = {
    "RF": lambda label, seed, p, w: RandomForestClassifier(
        labelCol=label, featuresCol=FEATURES, seed=seed, weightCol=w,
        numTrees=p.get("numTrees", 100), maxDepth=p.get("maxDepth", 6),
        maxBins=p.get("maxBins", 128), bootstrap=p.get("bootstrap", True),
        featureSubsetStrategy=p.get("featureSubsetStrategy", "auto")),
    "LR": lambda label, seed, p, w: LogisticRegression(
        labelCol=label, featuresCol=FEATURES, weightCol=w,
        regParam=p.get("regParam", 0.0), maxIter=p.get("maxIter", 100)),
}


@dataclass
class TrainingResult:
    leaderboard: DataFrame
    best: PipelineModel
    best_family: str
    best_params: dict
    best_score: float
    #: (family, params, rounds): rounds kept, null for families without rounds
    rounds: DataFrame
    #: all candidates' models, in the leaderboard's order (``ensemble.py`` weighs them)
    models: list[PipelineModel]


def expand_grid(grid: Mapping[str, Sequence] | None) -> list[dict]:
    """M3: every combination of the listed hyper-parameter values."""
    if not grid:
        return [{}]
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def _pipeline(feature_cols: Sequence[str], estimator) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol=FEATURES,
                                handleInvalid="keep")
    return Pipeline(stages=[assembler, estimator])


def class_weights(df: DataFrame, label: str, out_col: str = "weight") -> DataFrame:
    """Inverse-frequency weights for an imbalanced 0/1 label (each class sums to n/2).

    The class counts come from one aggregate (two numbers to the driver)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = {k: (n / (2.0 * v)) for k, v in counts.items() if v}
    expr = F.lit(1.0)
    for k, v in w.items():
        expr = F.when(F.col(label) == k, F.lit(v)).otherwise(expr)
    return df.withColumn(out_col, expr)


def _leaderboard(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        rows, "family string, params string, metric string, score double, is_champion boolean")


def train_regressors(train: DataFrame, validation: DataFrame, feature_cols: Sequence[str],
                     label: str, families: Mapping[str, Mapping[str, Sequence] | None] | None = None,
                     metric: str = "r2", seed: int = 7,
                     feature_sets: Mapping[str, Sequence[str]] | None = None) -> TrainingResult:
    """M1 + M2 + M3: fit each family x grid point, keep the best validation ``metric``. A family
    named in ``feature_sets`` gets those columns instead of ``feature_cols``."""
    families = families or {"RF": None, "GBM": None, "LM": None}

    def fit(rows, held_out, fam, p):
        columns = (feature_sets or {}).get(fam, feature_cols)
        if fam in BOOSTED:
            return boosting.fit_regressor(rows, held_out, columns, label, seed, p)
        return _pipeline(columns, REGRESSOR_FAMILIES[fam](label, seed, p)).fit(rows)
    return _train(train, validation, label, families, metric, fit, PREDICTION)


def train_classifiers(train: DataFrame, validation: DataFrame, feature_cols: Sequence[str],
                      label: str, families: Mapping[str, Mapping[str, Sequence] | None] | None = None,
                      metric: str = "auc", seed: int = 7, weight_col: str | None = None
                      ) -> TrainingResult:
    """M7: classifiers for the conversion probability; ``weight_col`` for imbalance."""
    families = families or {"RF": None, "LR": None}

    def fit(rows, held_out, fam, p):
        if fam in BOOSTED:
            return boosting.fit_classifier(rows, held_out, feature_cols, label, seed, p,
                                           weight_col)
        est = CLASSIFIER_FAMILIES[fam](label, seed, p, weight_col)
        if weight_col is None:
            est.clear(est.weightCol)
        return _pipeline(feature_cols, est).fit(rows)
    return _train(train, validation, label, families, metric, fit, P_CLASS1)


def _train(train, validation, label, families, metric, fit, score_col):
    m = METRICS[metric]
    # Every candidate (and every boosting/tree iteration) re-reads these two frames; keep
    # them on the executors for the loop. A lost block is recomputed from the staged
    # training table, so this is a cache, not a lineage cut.
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    validation = validation.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _search(train, validation, label, families, m, fit, score_col)
    finally:
        train.unpersist()
        validation.unpersist()


def _validation_scores(models, validation, label, m, score_col) -> list[float]:
    """The metric of every candidate on the validation rows, from one pass over all candidates'
    predictions grouped by candidate (a rank metric stages and orders them once)."""
    predictions = None
    for k, model in enumerate(models):
        pred = model.transform(validation)
        score = vector_to_array(PROBABILITY)[1] if score_col == P_CLASS1 else F.col(score_col)
        pred = pred.select(F.lit(k).alias(CANDIDATE), label, score.alias(score_col))
        predictions = pred if predictions is None else predictions.unionByName(pred)
    found = {r[CANDIDATE]: r[m.column] for r in evaluate(
        predictions, m.name, label, score_col, [CANDIDATE]).collect()}
    return [float("nan") if found.get(k) is None else float(found[k])
            for k in range(len(models))]


def _search(train, validation, label, families, m, fit, score_col):
    candidates = [(fam, params) for fam, grid in families.items() for params in expand_grid(grid)]
    if not candidates:
        raise ValueError("no model family to train")
    # Candidates are independent Spark jobs; a few run at once so one candidate's
    # driver-side iteration gaps are filled by another's tasks (like CrossValidator's
    # ``parallelism``). Results are collected in candidate order, so ties break the same
    # way on every run.
    workers = max(1, min(int(train.sparkSession.conf.get("bidlake.train.parallelism", "4")),
                         len(candidates)))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        futures = [pool.submit(fit, train, validation, fam, params) for fam, params in candidates]
        models = [f.result() for f in futures]
    fitted = list(zip(models, _validation_scores(models, validation, label, m, score_col)))
    rows, best = [], None
    for (fam, params), (model, score) in zip(candidates, fitted):
        rows.append([fam, json.dumps(params, sort_keys=True), m.name, score, False])
        better = best is None or (
            score == score and (best[0] != best[0] or
                                (score > best[0] if m.higher_is_better else score < best[0])))
        if better:
            best = (score, len(rows) - 1, model, fam, params)
    rows[best[1]][4] = True
    board = _leaderboard(train.sparkSession, [tuple(r) for r in rows])
    rounds = train.sparkSession.createDataFrame(
        [(fam, json.dumps(params, sort_keys=True), boosting.rounds_used(model))
         for (fam, params), (model, _) in zip(candidates, fitted)],
        "family string, params string, rounds int")
    return TrainingResult(board, best[2], best[3], best[4], best[0], rounds, models)


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> str:
    """K5: save the pipeline (assembler + model) to ``path``."""
    writer = model.write()
    if overwrite:
        writer = writer.overwrite()
    writer.save(path)
    return path
