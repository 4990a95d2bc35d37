"""Batch scoring of household vectors (IB, IS).

Household vectors: each audience household's latest impression, its campaign score and
its latest snapshot order, complete rows only, encoded with the *training* encoding
(fit once, reuse), one row per household. All cohorts are scored in one pass with a
``cohort`` column, and written partitioned by cohort and week.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BID_COLUMN, CONVERSION_COLUMN, KEY, SCORE
from ..models.score import score_probability, score_regression
from ..operators.encoding import OrdinalEncoding
from ..operators.relational import drop_incomplete, join_on_key
from ..sources import standins
from ..sources.files import write_csv
from . import features
from .training import household_snapshot


#: Files of one cohort and week, at most.
FILES_PER_LEAF = 8


def household_vectors_from(latest: DataFrame, scores: DataFrame, snapshot: DataFrame,
                           encoding: OrdinalEncoding | None = None) -> DataFrame:
    """One complete row per household from the caller's tables: its latest impression, its
    score and its snapshot row, all keyed ``ehhn``; encoded with the training encoding."""
    complete = drop_incomplete(join_on_key(join_on_key(latest, scores), snapshot))
    return encoding.transform(complete) if encoding is not None else complete


def household_vectors(spark: SparkSession, sf_dir: str, encoding: OrdinalEncoding | None = None
                      ) -> DataFrame:
    """The same over the stand-in tables."""
    return household_vectors_from(
        features.latest_impressions(spark, sf_dir),
        standins.campaign_scores(spark, sf_dir).select(KEY, SCORE, "cohort"),
        household_snapshot(spark, sf_dir), encoding)


def score_bids(model: PipelineModel, vectors: DataFrame, week: int = 1) -> DataFrame:
    """M5 + P14: ``(ehhn, week, basebid)``."""
    return score_regression(model, vectors).withColumn("week", F.lit(week))


def score_conversion(model: PipelineModel, vectors: DataFrame, week: int = 1) -> DataFrame:
    """M6 + M9 + P15: ``(ehhn, cohort, week, sales_conversion)`` for every cohort at once."""
    return score_probability(model, vectors, keep=("cohort",)).withColumn("week", F.lit(week))


def write_scores(scores: DataFrame, path: str, partition_by=("cohort", "week")) -> str:
    """K3: CSV without an index column; cohort and week in the directory names. Rows are
    first dealt by those columns (and salted by the key), so a cohort is a few files
    whatever the number of tasks, and a large one isn't written by one task."""
    cols = [c for c in partition_by if c in scores.columns]
    spread = F.pmod(F.xxhash64(KEY), F.lit(FILES_PER_LEAF))
    return write_csv(scores.repartition(*cols, spread), path, partition_by=cols)


def combined_predictions(bid_model: PipelineModel, conversion_model: PipelineModel,
                         vectors: DataFrame, week: int = 1) -> DataFrame:
    """Bid and conversion of each household as one table
    ``(ehhn, cohort, week, basebid, sales_conversion)``. Both models run over the same
    rows in one pass, so the vectors are computed once and nothing is joined."""
    keep = vectors.columns
    bids = score_regression(bid_model, vectors, keep=[c for c in keep if c != KEY])
    both = score_probability(conversion_model, bids, keep=("cohort", BID_COLUMN))
    return both.select(KEY, "cohort", F.lit(week).alias("week"), BID_COLUMN, CONVERSION_COLUMN)
