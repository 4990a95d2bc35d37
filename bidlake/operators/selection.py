"""The k-th smallest value of a group, without a sort (§2.13's medians, D7's exact samples).

Values are written once. Each round takes a grid of approximate quantiles of what is left of every
group, one aggregate whose state is a sketch of fixed size, and keeps the few cells around the
wanted rank; another aggregate counts exactly what lies below and inside. The bracket shrinks by
two orders of magnitude a round, whatever the distribution, until it is one value or holds at most
``few`` rows, which a window then numbers. So ten rows or a trillion, the driver sees one number a
round, and no task more than ``few`` rows of a group in order (and copies of one value, in any).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stage
from .broadcast import maybe_broadcast

#: Cells of the grid of quantiles, and the sketch's accuracy (ranks are right to 1 / ACCURACY).
CELLS = 256
ACCURACY = 10_000
#: Rows that a window may number.
FEW = 10_000
RANK = "k"
VALUE = "value"


def _same(a: str, b: str, groups: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
                                       for g in groups], F.lit(True))


def _inside(values: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The values in each target's bracket: (groups..., k, value, targets' columns)."""
    side, _ = maybe_broadcast(targets)
    within = F.col(f"v.{VALUE}").between(F.col("t.lo"), F.col("t.hi"))
    return values.alias("v").join(side.alias("t"), _same("v", "t", groups) & within).select(
        "t.*", F.col(f"v.{VALUE}"))


def kth_smallest(df: DataFrame, value: str, ranks: DataFrame, group_cols: Sequence[str] = (),
                 few: int = FEW) -> DataFrame:
    """``ranks`` (groups..., k) and the k-th smallest (from 1) non-null ``value`` of the group, as
    ``value``, with the number of smaller values as ``below``. A rank beyond the group's rows has
    no row. NaN counts as greater than all numbers; ``value`` may be any ordered number type."""
    groups = list(group_cols)
    kind = df.schema[value].dataType
    values = stage(df.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).alias(VALUE)), "selection")
    ends = values.groupBy(*groups).agg(F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"),
                                       F.count("*").alias("rows"))
    wanted = ranks.select(*groups, F.col(RANK).cast("bigint").alias(RANK))
    targets = stage(wanted.alias("w").join(ends.alias("e"), _same("w", "e", groups)).where(
        (F.col(RANK) >= 1) & (F.col(RANK) <= F.col("rows"))).select(
        "w.*", "lo", "hi", F.lit(0).cast("bigint").alias("below"), "rows"), "brackets")
    keys = [*groups, RANK]
    open_ = (F.col("lo") < F.col("hi")) & (F.col("rows") > few)
    while not targets.where(open_).isEmpty():
        grid = [i / CELLS for i in range(CELLS + 1)]
        cell = F.floor((F.col(RANK) - F.col("below") - 1) * CELLS / F.col("rows")).cast("int")
        cuts = _inside(values, targets.where(open_), groups).groupBy(
            *keys, "lo", "hi", "below", "rows").agg(
            F.percentile_approx(VALUE, grid, ACCURACY).alias("q")).select(
            *keys, "lo", "hi", "below", "rows",
            F.element_at("q", F.greatest(cell, F.lit(1))).cast(kind).alias("a"),
            F.element_at("q", F.least(cell + 3, F.lit(CELLS + 1))).cast(kind).alias("b"))
        cuts = stage(cuts, "cuts")
        counted = _inside(values, cuts, groups).groupBy(
            *keys, "lo", "hi", "below", "rows", "a", "b").agg(
            F.count_if(F.col(VALUE) == F.col("lo")).alias("least"),
            F.min(F.when(F.col(VALUE) > F.col("lo"), F.col(VALUE))).alias("second"),
            F.count_if(F.col(VALUE) < F.col("a")).alias("under"),
            F.count_if(F.col(VALUE).between(F.col("a"), F.col("b"))).alias("mid"),
            F.max(F.when(F.col(VALUE) < F.col("a"), F.col(VALUE))).alias("last"),
            F.min(F.when(F.col(VALUE) > F.col("b"), F.col(VALUE))).alias("next"))
        left = F.col(RANK) - F.col("below")
        low, high = left <= F.col("under"), left > F.col("under") + F.col("mid")
        first = left <= F.col("least")
        # whole numbers beyond 2**53 differ where the sketch's doubles don't: then the bracket
        # stays, and is cut behind its least value
        size = F.when(low, F.col("under")).when(
            high, F.col("rows") - F.col("under") - F.col("mid")).otherwise(F.col("mid"))
        stays = size == F.col("rows")
        narrowed = counted.select(
            *keys,
            F.when(first, F.col("lo")).when(stays, F.col("second")).when(low, F.col("lo"))
            .when(high, F.col("next")).otherwise(F.col("a")).alias("lo"),
            F.when(first, F.col("lo")).when(stays, F.col("hi")).when(low, F.col("last"))
            .when(high, F.col("hi")).otherwise(F.col("b")).alias("hi"),
            (F.col("below") + F.when(first, 0).when(stays, F.col("least")).when(low, 0)
             .when(high, F.col("under") + F.col("mid")).otherwise(F.col("under"))).alias("below"),
            F.when(first, F.col("least")).when(stays, F.col("rows") - F.col("least"))
            .otherwise(size).alias("rows"))
        targets = stage(targets.where(~open_).select(*keys, "lo", "hi", "below", "rows")
                        .unionByName(narrowed), "brackets")
    turn = Window.partitionBy(*keys).orderBy(VALUE)
    numbered = _inside(values, targets.where(F.col("lo") < F.col("hi")), groups).select(
        *keys, VALUE, "below", F.row_number().over(turn).alias("_turn"),
        F.rank().over(turn).alias("_rank"))
    found = numbered.where(F.col("_turn") == F.col(RANK) - F.col("below")).select(
        *keys, VALUE, (F.col("below") + F.col("_rank") - 1).alias("below"))
    single = targets.where(~(F.col("lo") < F.col("hi"))).select(
        *keys, F.col("lo").alias(VALUE), "below")
    return found.unionByName(single)


def medians(df: DataFrame, value: str, group_cols: Sequence[str] = (), few: int = FEW,
            out_col: str = "median") -> DataFrame:
    """The exact median of the non-null values: the middle one, or the mean of the middle two."""
    groups = list(group_cols)
    counts = df.groupBy(*groups).agg(F.count(value).alias("_n"))
    middle = F.array_distinct(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")))
    ranks = stage(counts.select(*groups, "_n", F.explode(middle).alias(RANK)), "median-ranks")
    both = kth_smallest(df, value, ranks.where(F.col("_n") > 0).drop("_n"), groups, few)
    found = both.groupBy(*groups).agg(
        (F.sum(F.col(VALUE).cast("double")) / F.count("*")).alias(out_col))
    every = ranks.select(*groups).distinct() if groups else ranks.select(F.lit(1).alias("_one")
                                                                          ).distinct()
    if not groups:
        return every.join(found, F.lit(True), "left").select(out_col)
    return every.alias("e").join(found.alias("f"), _same("e", "f", groups), "left").select(
        "e.*", out_col)
