"""Reproducible train / validation / test splits and the label operators.

Hash split (default): each row's bucket is ``md5(seed | key...)`` read as a number, mod
100; buckets below 60 train, below 80 validate, the rest test. No shuffle, no sort, same
answer on every rerun and in any SQL engine with md5.

Exact split: the reference cuts a shuffled frame at positions floor(.6n) and floor(.8n).
Here the "shuffle" is the order of the full md5 hash (ties broken by the key); hashes are counted
by their first digits, and only the rows next to the two cuts are ordered.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABEL, SHIFT_BASE, SHIFT_SPAN, SPLIT_FRACTIONS
from ..sources.files import stage
from .broadcast import maybe_broadcast
from .selection import FEW, RANK, VALUE, kth_smallest

SPLIT = "split"
TRAIN, VALIDATION, TEST = "train", "validation", "test"
_HASH, _NUMBER = "_split_hash", "_split_number"


def _key_text(c: str) -> Column:
    # Spark's text of a double holds all its digits, so near values hash apart. A null is
    # written as such ("-"), or ('a', null) and (null, 'a') would hash alike. A caller that
    # needs the same text from another engine passes a string or decimal column.
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def hash_text(key_cols: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_key_text(c) for c in key_cols]))


def _number(hash_col: str) -> Column:
    """The first 52 bits of a hash's text, as a whole number that a double holds."""
    return F.conv(F.substring(F.col(hash_col), 1, 13), 16, 10).cast("bigint")


def hash_bucket(key_cols: Sequence[str], seed: int, buckets: int = 100) -> Column:
    head = F.substring(hash_text(key_cols, seed), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(buckets)


def _percent(fractions: Sequence[float]) -> tuple[int, int]:
    a, b = (int(round(f * 100)) for f in fractions)
    return a, b


def hash_split(df: DataFrame, key_cols: Sequence[str], seed: int,
               fractions: Sequence[float] = SPLIT_FRACTIONS, out_col: str = SPLIT) -> DataFrame:
    """T3 (default mode): add ``split`` in {train, validation, test}; about 60/20/20."""
    a, b = _percent(fractions)
    bucket = hash_bucket(key_cols, seed)
    return df.withColumn(out_col, F.when(bucket < a, TRAIN).when(bucket < b, VALIDATION)
                         .otherwise(TEST))


def _cut_prefix(counts: list[tuple[str, int]], below: int, rank: int) -> tuple[str, int, int]:
    """(prefix, rows before it, rows in it) of the bucket that holds the row at ``rank`` (from 1),
    ``below`` rows being before all buckets."""
    for prefix, n in sorted(counts):
        if rank <= below + n:
            return prefix, below, n
        below += n
    raise ValueError(f"no row at rank {rank}")


def exact_split(df: DataFrame, key_cols: Sequence[str], seed: int,
                fractions: Sequence[float] = SPLIT_FRACTIONS, out_col: str = SPLIT,
                partitions: int | None = None, few: int = FEW) -> DataFrame:
    """T2 + T3 (exact mode): sizes floor(.6n), floor(.8n) - floor(.6n), n - floor(.8n).

    Only the rows next to the two cuts need an order. Hashes are counted by their first four hex
    digits (65 536 numbers to the driver, whatever the input), and the two buckets that hold a cut
    by their next four, until such a bucket has at most ``few`` rows. Rows of all other buckets get
    their label where they lie, without a shuffle; those of the two buckets are numbered. Rows and
    hashes are written once, as the counts and the labels both read them. ``partitions`` is kept
    for callers and has no effect."""
    a, b = _percent(fractions)
    hashed = stage(df.withColumn(_HASH, hash_text(key_cols, seed)), "exact-split")
    hashes = hashed.select(_HASH)

    def prefix(length: int) -> Column:
        return F.substring(F.col(_HASH), 1, length)

    def counted(length: int, within: list[str]) -> list[tuple[str, int]]:
        rows = hashes.where(prefix(length - 4).isin(within)) if within else hashes
        return [(r["p"], r["n"]) for r in rows.groupBy(prefix(length).alias("p")).agg(
            F.count(F.lit(1)).alias("n")).collect()]

    length = 4
    counts = counted(length, [])
    n = sum(c for _, c in counts)
    cuts = sorted({k for k in (n * a // 100, n * b // 100) if k})
    found = {k: _cut_prefix(counts, 0, k) for k in cuts}
    while length < 32 and any(rows > few for _, _, rows in found.values()):
        length += 4
        finer = counted(length, [p for p, _, _ in found.values()])
        found = {k: _cut_prefix([x for x in finer if x[0].startswith(p)], below, k)
                 for k, (p, below, _) in found.items()}

    def named(position: Column) -> Column:
        return F.when(position <= n * a // 100, TRAIN).when(
            position <= n * b // 100, VALIDATION).otherwise(TEST)

    # a row outside the cuts' buckets lies behind all cuts whose bucket is before its own
    own, behind = prefix(length), F.lit(0)
    for k, (p, _, _) in found.items():
        behind = F.when(own > p, k + 1).otherwise(behind)
    at_cut = own.isin([p for p, _, _ in found.values()]) if found else F.lit(False)
    before = F.lit(0)
    for p, below, _ in found.values():
        before = F.when(own == p, below).otherwise(before)
    position = F.row_number().over(Window.partitionBy(own).orderBy(_HASH, *key_cols)) + before
    start = F.when(behind > 0, behind).otherwise(0 if cuts and cuts[0] == n * a // 100
                                                 else n * a // 100 + 1)
    inner = hashed.where(~at_cut).select(*df.columns, named(start).alias(out_col))
    ties = hashed.where(at_cut).withColumn("_position", position).select(
        *df.columns, named(F.col("_position")).alias(out_col))
    return inner.unionByName(ties)


def shift_value(seed: int) -> float:
    """u ~ U(0, SHIFT_SPAN), drawn once per run from a seeded generator."""
    return random.Random(seed).uniform(0.0, SHIFT_SPAN)


def label_shift(df: DataFrame, label: str = LABEL, u: float = 0.0) -> DataFrame:
    """P11 + P12: cast the label to double and apply the second-price shift
    ``label - SHIFT_BASE + u``, the same constant for every row."""
    shifted = F.col(label).cast("double") - F.lit(SHIFT_BASE) + F.lit(float(u))
    return df.withColumn(label, shifted)


def features_and_label(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """The frame without the label, and the label alone."""
    return df.drop(label), df.select(label)


def stratified_sample(df: DataFrame, label: str, fractions: dict, seed: int) -> DataFrame:
    """A seeded per-class sample (e.g. keep every rare positive, a share of the
    negatives) for the "sampled" training set the workflow trains on. A sampling
    operator: the fractions are the feature, nothing else is capped."""
    return df.sampleBy(label, fractions=fractions, seed=seed)


def exact_sample(df: DataFrame, label: str, sizes: dict, key_cols: Sequence[str],
                 seed: int, few: int = FEW) -> DataFrame:
    """Exactly ``sizes[class]`` rows of each class (all, if it has fewer; none of a class that
    isn't named): those with the smallest seeded hashes of their keys, in any order.

    The hash that bounds a class is its k-th smallest, found by selection, not by a sort; all rows
    below it are taken where they lie. Rows whose hash equals the bound (one, or copies of a key)
    are numbered by their keys, so many of them may be equal, but not different."""
    h, bound = "_sample_hash", "_sample_bound"
    tagged = stage(df.withColumn(h, hash_text(key_cols, seed)).withColumn(h, _number(h)),
                   "exact-sample")
    spark = df.sparkSession
    kind = df.schema[label].dataType
    named = spark.createDataFrame(
        [(None if c is None else str(c), int(n)) for c, n in sizes.items()],
        f"c string, {RANK} bigint").select(F.col("c").cast(kind).alias(label), RANK)
    counts = stage(tagged.groupBy(label).agg(F.count("*").alias("_n")), "classes")
    wanted = counts.join(named.withColumnRenamed(label, "_c"), F.col(label).eqNullSafe(F.col("_c"))
                         ).select(label, F.least(RANK, "_n").alias(RANK)).where(F.col(RANK) > 0)
    found = kth_smallest(tagged, h, wanted, [label], few).select(
        F.col(label).alias("_c"), F.col(VALUE).alias(bound),
        (F.col(RANK) - F.col("below")).alias("_still"))
    limits, _ = maybe_broadcast(found)
    kept = tagged.join(limits, F.col(label).eqNullSafe(F.col("_c")) & (F.col(h) <= F.col(bound)))
    below = kept.where(F.col(h) < F.col(bound))
    at = kept.where(F.col(h) == F.col(bound)).withColumn("_turn", F.row_number().over(
        Window.partitionBy("_c").orderBy(*key_cols))).where(F.col("_turn") <= F.col("_still"))
    return below.select(*df.columns).unionByName(at.select(*df.columns))
