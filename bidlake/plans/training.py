"""Bid-price and conversion training (TR, and M7 for the conversion model).

Training rows are impressions of audience households with the household's campaign
score and latest snapshot features; the label is the impression's cost
(``MediaCostInBucks``, renamed ``biddingprice``). Steps:

1. split by a seeded hash of the impression id (T3) - before the id is excluded;
2. fit the ordinal encoding on all rows, ordered by impression id (E1), and apply it (E2);
3. drop identifier/leakage columns by the exclusion list (P6); rename the label (P4);
4. second-price label shift with one seeded constant (P11, P12);
5. the split rows are staged before encoding (lineage cut): the encoder fit and every
   candidate fit re-read them, and encoding them again is a broadcast join of the mapping;
6. fit the model families, keep the best validation R^2 (M1-M3), score the test split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EVENT_TIME, EXCLUDED_TRAINING_COLUMNS, KEY, LABEL, SCORE, SOURCE_LABEL
from ..functions.metrics import average_precision, regression_metrics, roc_auc, threshold_metrics
from ..models.train import (
    P_CLASS1,
    PREDICTION,
    PROBABILITY,
    TrainingResult,
    class_weights,
    train_classifiers,
    train_regressors,
)
from ..operators.broadcast import maybe_broadcast
from ..operators.encoding import OrdinalEncoding, ordinal_fit
from ..operators.latest import latest_per_key
from ..operators.relational import (
    drop_incomplete,
    exclude_columns,
    join_on_key,
    rename_columns,
)
from ..operators.split import (
    SPLIT,
    TEST,
    TRAIN,
    VALIDATION,
    hash_split,
    label_shift,
    shift_value,
    stratified_sample,
)
from ..operators.target_stats import TargetStatistics, ordered_target_statistics
from ..sources import standins
from ..sources.files import stage
from . import features

# --- fixed values -------------------------------------------------------------
DEFAULT_SEED = 42
ROW_ID = "ImpressionId"
BID_CATEGORICALS = ["event_type", "prop_k", "o_orderstatus", "o_orderpriority"]
BID_FEATURES = ["event_type", "prop_k", "UserHourOfWeek", "ngr_score", "o_totalprice",
                "o_orderstatus", "o_orderpriority"]
CONVERSION_LABEL = "converted"
CONVERSION_EVENT = "purchase"
CONVERSION_FEATURES = ["prop_k", "UserHourOfWeek", "ngr_score", "o_totalprice", "o_orderstatus",
                       "o_orderpriority"]
# --- end of fixed values -------------------------------------------------------


def training_rows_from(log: DataFrame, scores: DataFrame, snapshot: DataFrame,
                       converted: Column | None = None) -> DataFrame:
    """Complete training rows (no null or NaN in any column) from the caller's tables.

    ``log`` holds impressions with their cost and a row id; ``scores`` and ``snapshot`` one row
    per household; all are keyed ``ehhn``. ``converted`` is the 0/1 outcome of an impression.

    The household side has one row per key, so it is joined first and the log is joined to
    it once: that single inner join both restricts the log to the audience and attaches the
    features. The household side is broadcast when its size allows; otherwise it is staged, so
    the join reads two plain shuffles and AQE can split a hot household's partition
    (docs/SKEW.md).
    """
    households = join_on_key(scores, snapshot)
    # At most one row per score row: the score table's count bounds the household side.
    households, small = maybe_broadcast(households, bound=scores)
    if not small:
        households = stage(households, "households")
    rows = log.join(households, KEY, "inner")
    if converted is not None:
        rows = rows.withColumn(CONVERSION_LABEL, converted.cast("int"))
    return drop_incomplete(rows)


# ---------------------------------------------------------------------------------
# The same over the driver's stand-in tables.
# ---------------------------------------------------------------------------------
SNAPSHOT_FEATURES = ["o_totalprice", "o_orderstatus", "o_orderpriority"]


def household_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot order per household (one row per key)."""
    return latest_per_key(standins.media_engagement(spark, sf_dir), KEY, "o_orderdate",
                          "o_orderkey")


def standin_training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = rename_columns(features.impression_log(spark, sf_dir),
                         {"event_id": ROW_ID, "cost": SOURCE_LABEL})
    return log.select(ROW_ID, KEY, EVENT_TIME, "event_type", "prop_k", "UserHourOfWeek",
                      SOURCE_LABEL)


def bid_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows_from(
        standin_training_log(spark, sf_dir),
        standins.campaign_scores(spark, sf_dir).select(KEY, SCORE, "cohort"),
        household_snapshot(spark, sf_dir).select(KEY, *SNAPSHOT_FEATURES),
        F.col("event_type") == CONVERSION_EVENT)


def prepare_training(rows: DataFrame, categoricals: list[str], row_id: str, seed: int,
                     encoding: OrdinalEncoding | None = None, materialize: bool = True
                     ) -> tuple[DataFrame, OrdinalEncoding]:
    """Steps 1-4 on any frame that has ``row_id``, the categoricals and the source label.

    With ``materialize`` the split rows are staged once, so the encoder fit (which reads
    only the categorical columns and the id) and the transform both read the staged copy
    instead of recomputing the joins and rescanning the log.
    """
    with_split = hash_split(rows, [row_id], seed)
    if materialize:
        with_split = stage(with_split, "training-rows")
    enc = encoding or ordinal_fit(with_split, categoricals, row_id)
    encoded = enc.transform(with_split)
    kept = exclude_columns(encoded, EXCLUDED_TRAINING_COLUMNS)
    renamed = rename_columns(kept, {SOURCE_LABEL: LABEL})
    return label_shift(renamed, LABEL, shift_value(seed)), enc


def prepare_with_statistics(rows: DataFrame, categoricals: list[str], row_id: str, seed: int
                            ) -> tuple[DataFrame, OrdinalEncoding, TargetStatistics]:
    """Steps 1-4 and, for each categorical, its ordered target statistics (``<column>_ts``): of
    the training rows before it for a training row, of all training rows for any other."""
    ordered = "_statistics_order"
    prepared, enc = prepare_training(rows.withColumn(ordered, F.col(row_id)), categoricals,
                                     row_id, seed)
    train = prepared.where(F.col(SPLIT) == TRAIN)
    with_own, stats = ordered_target_statistics(train, categoricals, LABEL, ordered, seed)
    rest = stats.transform(prepared.where(F.col(SPLIT) != TRAIN))
    return stage(with_own.unionByName(rest).drop(ordered), "with-statistics"), enc, stats


@dataclass
class BidTraining:
    prepared: DataFrame
    encoding: OrdinalEncoding
    result: TrainingResult
    test_metrics: DataFrame


def prepared_bid_rows(spark: SparkSession, sf_dir: str, seed: int = DEFAULT_SEED
                      ) -> tuple[DataFrame, OrdinalEncoding]:
    """Steps 1-5: the prepared training table (over the staged rows) and its encoding.
    Re-reading it for every candidate fit costs a scan plus broadcast joins on the small
    mapping, not the joins that built the rows."""
    return prepare_training(bid_training_rows(spark, sf_dir), BID_CATEGORICALS, ROW_ID, seed)


def train_bid_model(spark: SparkSession, sf_dir: str, families=None, seed: int = DEFAULT_SEED,
                    prepared: DataFrame | None = None,
                    encoding: OrdinalEncoding | None = None,
                    train_fraction: float | None = None,
                    feature_cols=tuple(BID_FEATURES), feature_sets=None) -> BidTraining:
    """Train on ``prepared`` rows (default: the stand-ins'). ``train_fraction``: fit on a seeded
    sample of the training split (the workflow trains on a sampled set); validation and test stay
    whole. Default: the whole split. ``feature_sets``: other columns for single families."""
    if prepared is None:
        prepared, encoding = prepared_bid_rows(spark, sf_dir, seed)
    train = prepared.where(F.col(SPLIT) == TRAIN)
    if train_fraction is not None:
        train = train.sample(fraction=train_fraction, seed=seed)
    val = prepared.where(F.col(SPLIT) == VALIDATION)
    test = prepared.where(F.col(SPLIT) == TEST)
    result = train_regressors(train, val, list(feature_cols), LABEL, families, "r2", seed,
                              feature_sets)
    test_metrics = regression_metrics(result.best.transform(test), LABEL, PREDICTION)
    return BidTraining(prepared, encoding, result, test_metrics)


def train_conversion_model(prepared: DataFrame, families=None,
                           seed: int = DEFAULT_SEED, weighted: bool = True,
                           class_fractions: dict | None = None,
                           feature_cols=tuple(CONVERSION_FEATURES)) -> TrainingResult:
    """M7: conversion classifier on the same prepared rows (label ``converted``), with
    inverse-frequency class weights for the imbalance. ``class_fractions`` (D7) samples
    the training split per class, e.g. ``{1: 1.0, 0: 0.2}`` keeps every conversion."""
    data = class_weights(prepared, CONVERSION_LABEL) if weighted else prepared
    train = data.where(F.col(SPLIT) == TRAIN)
    if class_fractions is not None:
        train = stratified_sample(train, CONVERSION_LABEL, class_fractions, seed)
    val = data.where(F.col(SPLIT) == VALIDATION)
    return train_classifiers(train, val, list(feature_cols), CONVERSION_LABEL, families,
                             "auc", seed, "weight" if weighted else None)


def conversion_test_metrics(model, prepared: DataFrame, group_cols=("cohort",),
                            threshold: float = 0.5) -> DataFrame:
    """Held-out evaluation of the conversion model per cohort: AUC, average precision and
    the threshold metrics of ``P(class 1) > threshold``, one row per cohort."""
    test = prepared.where(F.col(SPLIT) == TEST)
    groups = list(group_cols)
    if not groups:
        raise ValueError("conversion_test_metrics needs a group column")
    # The model is applied once: the three metrics read the staged scores.
    scored = stage(model.transform(test).select(
        *groups, CONVERSION_LABEL, vector_to_array(PROBABILITY)[1].alias(P_CLASS1)), "scored-test")
    auc = roc_auc(scored, CONVERSION_LABEL, P_CLASS1, groups)
    ap = average_precision(scored, CONVERSION_LABEL, P_CLASS1, groups)
    thr = threshold_metrics(scored, CONVERSION_LABEL, P_CLASS1, threshold, groups)
    # One row per cohort on each side (a handful of rows), joined on the cohort.
    return thr.join(auc, groups, "left").join(ap, groups, "left")
