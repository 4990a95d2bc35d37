"""Conversion report.

* ``conversion_share``: per cohort, the share of scored households whose conversion
  probability is strictly above the threshold, among households that also have a
  campaign score. NaN is not above the threshold but counts in the denominator; a cohort
  without rows reports a NULL share. Scored cohorts that the caller doesn't list are
  reported too.
* ``score_bins``: the 2-D histogram a probability-vs-score scatter plot needs,
  ``(cohort, p_bin, s_bin, households)``; bins are computed on the executors, only the
  min/max of the score reach the driver; the joined rows are staged so the join runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CONVERSION_COLUMN, CONVERSION_THRESHOLD, KEY, SCORE
from ..operators.relational import join_on_key
from ..sources.files import stage


def conversion_share(predictions: DataFrame, scores: DataFrame, cohorts: Sequence[str],
                     threshold: float = CONVERSION_THRESHOLD, prob_col: str = CONVERSION_COLUMN,
                     cohort_col: str = "cohort") -> DataFrame:
    joined = join_on_key(scores.select(KEY, SCORE), predictions.select(KEY, cohort_col, prob_col))
    p = F.col(prob_col)
    counts = (joined.groupBy(cohort_col).agg(
                  F.count(F.lit(1)).cast("bigint").alias("households"),
                  F.count_if((p > F.lit(threshold)) & ~F.isnan(p)).cast("bigint").alias("converting")))
    # Every listed cohort gets a row: zero counts are unioned in and summed, so an empty
    # cohort reports 0 households and a NULL share (no join needed).
    spark = predictions.sparkSession
    zeros = spark.range(1).select(
        F.explode(F.array(*[F.lit(str(c)) for c in cohorts])).alias(cohort_col),
        F.lit(0).cast("bigint").alias("households"), F.lit(0).cast("bigint").alias("converting"))
    out = counts.unionByName(zeros).groupBy(cohort_col).agg(
        F.sum("households").cast("bigint").alias("households"),
        F.sum("converting").cast("bigint").alias("converting"))
    share = F.try_divide(F.col("converting").cast("double"), F.col("households").cast("double"))
    return out.select(cohort_col, "households", "converting", share.alias("share"))


def score_bins(predictions: DataFrame, scores: DataFrame, prob_bins: int = 20,
               score_bins: int = 20, prob_col: str = CONVERSION_COLUMN,
               cohort_col: str = "cohort") -> DataFrame:
    joined = join_on_key(scores.select(KEY, SCORE), predictions.select(KEY, cohort_col, prob_col))
    joined = joined.where(F.col(SCORE).isNotNull() & ~F.isnan(SCORE)
                          & F.col(prob_col).isNotNull() & ~F.isnan(prob_col))
    # The join is done once: its three needed columns are staged, then read for the range
    # and again for the bins.
    joined = stage(joined.select(cohort_col, SCORE, prob_col), "score-bins-input")
    lo, hi = joined.agg(F.min(SCORE), F.max(SCORE)).first()
    if lo is None:
        return joined.select(cohort_col, F.lit(0).alias("p_bin"), F.lit(0).alias("s_bin"),
                             F.lit(0).cast("bigint").alias("households")).limit(0)
    width = (hi - lo) / score_bins if hi > lo else 1.0
    p_bin = F.least(F.floor(F.col(prob_col) * F.lit(prob_bins)), F.lit(prob_bins - 1))
    s_bin = F.least(F.floor((F.col(SCORE) - F.lit(lo)) / F.lit(width)), F.lit(score_bins - 1))
    return joined.groupBy(cohort_col, p_bin.cast("int").alias("p_bin"),
                          s_bin.cast("int").alias("s_bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("households"))
