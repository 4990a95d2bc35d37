"""Ordered running totals and row numbers without a single-task window.

``row_number() over (order by x)`` with no (or a very coarse) partition puts every row
in one task. Here the rows are range-partitioned on ``(group, order)`` instead; each
range partition computes local running totals, the per-partition totals (a table of at
most partitions x groups-per-partition rows) give each partition its offset, and the
offsets are joined back. Every task handles about 1/partitions of the data, whatever
the group sizes.

Without group columns the offsets are a running sum over the per-partition totals in one
task: that table has at most ``partitions`` rows, so the single task is bounded by the
partition count, not by the data.

The order columns must be a total order within each group (rows with equal order
values land in the same range partition, but their relative order is arbitrary).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stage

_PART = "_seq_part"


def _as_col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def running_totals(df: DataFrame, order_cols: Sequence[str | Column], sum_cols: Sequence[str],
                   group_cols: Sequence[str] = (), partitions: int | None = None,
                   suffix: str = "_cum", with_total: bool = False,
                   bucket: Column | None = None) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over all rows of the group up to and including
    this row, in ``order_cols`` order (a Column may carry ``.desc()``). With
    ``with_total`` also ``<c>_total``, the sum over the whole group.

    ``bucket``: optional integer Column, a deterministic function of the row that never
    decreases along ``order_cols`` within a group and spreads rows evenly (e.g. a prefix
    of a hash the rows are ordered by). It replaces the sampled range partitioning: both
    the local sums and the per-bucket totals compute the same bucket from the row, so
    nothing has to be staged."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = list(group_cols)
    order = [_as_col(c) for c in order_cols]
    w_local = (Window.partitionBy(_PART, *groups).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if bucket is not None:
        keyed = df.withColumn(_PART, bucket)
        local = keyed.select("*", *[F.sum(c).over(w_local).alias(f"_loc_{c}") for c in sum_cols])
        totals = keyed.groupBy(_PART, *groups).agg(
            *[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    else:
        ranged = (df.repartitionByRange(n, *[F.col(g) for g in groups], *order)
                  .withColumn(_PART, F.spark_partition_id()))
        # Local running sums and per-partition totals come from one window stage over the
        # same rows. That result is staged before it is read twice (for the offsets and for
        # the final join): two separately planned range exchanges would sample their bounds
        # independently, and a row could then carry different partition ids in the two reads.
        w_part = Window.partitionBy(_PART, *groups)
        local = stage(ranged.select(
            "*", *[F.sum(c).over(w_local).alias(f"_loc_{c}") for c in sum_cols],
            *[F.sum(c).over(w_part).alias(f"_tot_{c}") for c in sum_cols]), "running-totals")
        totals = local.groupBy(_PART, *groups).agg(
            *[F.max(f"_tot_{c}").alias(f"_tot_{c}") for c in sum_cols])
    w_off = (Window.partitionBy(*groups).orderBy(_PART)
             .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*groups)
    offsets = totals.select(
        F.col(_PART).alias("_o_part"), *[F.col(g).alias(f"_o_{g}") for g in groups],
        *[F.coalesce(F.sum(f"_tot_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}")
          for c in sum_cols],
        *[F.sum(f"_tot_{c}").over(w_all).alias(f"_all_{c}") for c in sum_cols],
    )
    cond = reduce(lambda a, b: a & b,
                  [F.col(_PART) == F.col("_o_part")]
                  + [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups])
    out = local.join(offsets, cond, "inner")
    extra = [F.col(f"_all_{c}").alias(f"{c}_total") for c in sum_cols] if with_total else []
    return out.select(*df.columns,
                      *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"{c}{suffix}")
                        for c in sum_cols], *extra)


def row_numbers(df: DataFrame, order_cols: Sequence[str | Column], out_col: str = "row_number",
                group_cols: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """1-based row number within each group in ``order_cols`` order (bigint)."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(ones, order_cols, ["_one"], group_cols, partitions)
    return ranked.withColumnRenamed("_one_cum", out_col).drop("_one")
