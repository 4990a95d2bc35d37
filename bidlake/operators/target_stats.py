"""Ordered target statistics of categorical columns (M1 CAT).

A category is replaced by a mean of the label. On training rows that mean may not hold the row's
own label, or the model learns its answer. So the rows get a seeded order, and a row's value is
the mean over the rows of its category *before* it, drawn to the prior:

    (sum of earlier labels + a * prior) / (number of earlier rows + a)

``prior`` is the mean label of all fitted rows and ``a`` its weight. Any other row (validation,
test, scoring) gets the same with all fitted rows of the category. A category that the fit hasn't
seen, null included, gets the prior; a null that it has seen is a category like any other.

Plan: rows of all columns are unpivoted once, range-partitioned by (column, category, order) and
totalled inside their partition; offsets of the partitions are joined back
(``operators/sequence.py``). A hot category is cut over as many partitions as its rows need, and
no window holds more than one of them. The fitted table has a row per column and category.

The order is the md5 of seed and row id, ties by the id, so it is the same in any engine. Ids
should be unique: of rows with one id, the order is any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import stage
from .broadcast import maybe_broadcast
from .sequence import running_totals
from .split import hash_text

FEATURE = "feature"
CATEGORY = "category"
SUFFIX = "_ts"
#: Weight of the prior, in rows.
PRIOR_WEIGHT = 1.0


def _unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column]) -> DataFrame:
    """(keep..., feature, category): a row for each row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias(FEATURE), F.col(c).cast("string").alias(CATEGORY))
                      for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_kv")).select(
        "*", f"_kv.{FEATURE}", f"_kv.{CATEGORY}").drop("_kv")


@dataclass
class TargetStatistics:
    """Fitted sums. ``table`` columns: feature, category, label_sum, label_count."""

    table: DataFrame
    columns: list[str]
    prior: float
    weight: float

    def value(self, total: Column, count: Column) -> Column:
        """The statistic of a category with that sum and number of labels."""
        return ((F.coalesce(total, F.lit(0.0)) + F.lit(self.weight * self.prior))
                / (F.coalesce(count, F.lit(0)).cast("double") + F.lit(self.weight)))

    def transform(self, df: DataFrame, suffix: str = SUFFIX) -> DataFrame:
        """``df`` and ``<column><suffix>`` for each column, from all fitted rows. A column's part
        of the table is broadcast if its bytes allow."""
        out = df
        for k, c in enumerate(self.columns):
            part = self.table.where(F.col(FEATURE) == c).select(
                F.col(CATEGORY).alias("_t_category"), F.col("label_sum").alias("_t_sum"),
                F.col("label_count").alias("_t_count"))
            small, _ = maybe_broadcast(part)
            out = out.join(small, F.col(c).cast("string").eqNullSafe(F.col("_t_category")), "left")
            out = out.withColumn(f"{c}{suffix}", self.value(F.col("_t_sum"), F.col("_t_count"))
                                 ).drop("_t_category", "_t_sum", "_t_count")
        return out


def fit_target_statistics(df: DataFrame, columns: Sequence[str], label: str,
                          weight: float = PRIOR_WEIGHT) -> TargetStatistics:
    """Sums and counts of the label by category, one aggregate for all columns. Rows without a
    label don't count."""
    if weight <= 0:
        raise ValueError("the prior needs a positive weight")
    rows = df.where(F.col(label).isNotNull())
    prior = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    long = _unpivoted(rows, columns, [F.col(label).cast("double").alias("_y")])
    table = stage(long.groupBy(FEATURE, CATEGORY).agg(
        F.sum("_y").alias("label_sum"), F.count("_y").alias("label_count")), "target-statistics")
    return TargetStatistics(table, list(columns), float(prior or 0.0), float(weight))


def ordered_target_statistics(df: DataFrame, columns: Sequence[str], label: str, row_id: str,
                              seed: int, fitted: TargetStatistics | None = None,
                              weight: float = PRIOR_WEIGHT, suffix: str = SUFFIX,
                              partitions: int | None = None
                              ) -> tuple[DataFrame, TargetStatistics]:
    """``df`` (the fitted rows) and ``<column><suffix>`` for each column from the rows before
    each; and the fitted sums for other rows. A row without a label has a value, but adds none."""
    stats = fitted or fit_target_statistics(df, columns, label, weight)
    keys = [F.col(row_id).alias("_id"), hash_text([row_id], seed).alias("_order"),
            F.col(label).cast("double").alias("_y")]
    long = _unpivoted(df, stats.columns, keys).withColumns({
        "_s": F.coalesce("_y", F.lit(0.0)), "_n": F.col("_y").isNotNull().cast("bigint")})
    totals = running_totals(long, [F.col("_order"), F.col("_id")], ["_s", "_n"],
                            [FEATURE, CATEGORY], partitions)
    # without the row itself
    value = stats.value(F.col("_s_cum") - F.col("_s"), F.col("_n_cum") - F.col("_n"))
    wide = totals.groupBy("_id").agg(*[
        F.max(F.when(F.col(FEATURE) == c, value)).alias(f"{c}{suffix}") for c in stats.columns])
    joined = df.join(wide, F.col(row_id).eqNullSafe(F.col("_id")), "left").drop("_id")
    return joined, stats
