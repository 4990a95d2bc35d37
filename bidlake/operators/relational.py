"""Projection, union, audience restriction, joins and key coverage (P*, U*, J*, F3, A1-A4).

All operators are plain DataFrame transformations. The only actions are bounded
checks: the size of a dimension-sized side before broadcasting it, and an
optional key-uniqueness check before a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import KEY
from .broadcast import maybe_broadcast
from .latest import latest_per_key

class FanOutError(ValueError):
    """Raised when a join that must be one-to-one finds repeated keys on the right."""


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename, failing on a source name that does not exist (Spark's own
    ``withColumnRenamed`` silently ignores it)."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"cannot rename missing columns {missing}; have {df.columns}")
    return df.withColumnsRenamed(dict(mapping))


def exclude_columns(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Drop every listed name that is present (leakage guard); absent names are
    ignored, repeated names are harmless. Column order of the rest is kept."""
    drop = set(excluded)
    return df.select(*[c for c in df.columns if c not in drop])


def union_logs(frames: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """U1 + P1: union all, aligned by column name, then (optionally) project.

    The projection is applied to each input before the union; Catalyst would push it
    down anyway, and the scans then read only these columns.
    """
    if not frames:
        raise ValueError("union_logs needs at least one frame")
    if columns:
        frames = [f.select(*columns) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """A3: the distinct key set (partial aggregate before the shuffle)."""
    return df.select(key).distinct()


def audience(log: DataFrame, scores: DataFrame, key: str = KEY) -> DataFrame:
    """Households present in both the impression log and the campaign score
    (distinct, null-safe intersect; Spark plans it as a semi join plus aggregate)."""
    return log.select(key).intersect(scores.select(key))


def restrict_to_keys(df: DataFrame, keys: DataFrame, key: str = KEY,
                     max_broadcast_bytes: int | None = None) -> DataFrame:
    """Keep rows of ``df`` whose key is in ``keys`` (left semi join: no duplicate
    rows, no right columns). ``keys`` is broadcast only behind a check of its bytes; a large
    key set falls back to a shuffled semi join, which AQE can split when skewed.
    Before a per-key window prefer ``latest_within_keys``, which orders the two steps so
    a hot key never reaches one task whole."""
    # Duplicate keys do not change a semi join, so no distinct (and no shuffle) first;
    # its size is then an upper bound on the distinct keys'.
    keys, _ = maybe_broadcast(keys.select(key), max_broadcast_bytes)
    return df.join(keys, key, "left_semi")


def check_unique(df: DataFrame, key: str | Sequence[str] = KEY) -> None:
    """Raise FanOutError if any key appears more than once (one distributed aggregate;
    only the first offending key comes back to the driver)."""
    keys = [key] if isinstance(key, str) else list(key)
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise FanOutError(f"right side is not unique on {keys}: e.g. {dup[0].asDict()}")


def join_on_key(left: DataFrame, right: DataFrame, key: str = KEY, how: str = "inner",
                on_duplicate: str = "keep", order_by: Sequence[str] | None = None,
                tie_breaker: str | None = None) -> DataFrame:
    """Equi-join on the household key, key column once, first.

    ``on_duplicate`` chooses what a repeated key on the right does:
    ``keep``   - every match is kept (rows multiply, as an inner join does);
    ``error``  - raise FanOutError before joining;
    ``latest`` - keep the right row with the greatest ``order_by`` (all its columns, in
    order, then ``tie_breaker``).
    Nulls never match (SQL semantics).
    """
    if on_duplicate == "error":
        check_unique(right, key)
    elif on_duplicate == "latest":
        if not order_by:
            raise ValueError("on_duplicate='latest' needs order_by")
        right = latest_per_key(right, key, list(order_by), tie_breaker)
    elif on_duplicate != "keep":
        raise ValueError(f"unknown on_duplicate policy {on_duplicate!r}")
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValueError(f"columns {sorted(shared)} exist on both sides; rename first")
    return left.join(right, key, how)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """drop rows holding a null (or a floating NaN) in any column of ``subset``
    (default: all columns)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def key_coverage(base: DataFrame, others: Mapping[str, DataFrame], key: str = KEY) -> DataFrame:
    """A1 + A4: overlap of the key set of ``base`` with each other source.

    One row per source: ``(source, base_keys, source_keys, shared_keys)``, counting
    distinct keys (null counts as one key, as in ``intersect``). All sources are tagged
    and unioned, grouped once by key (partial aggregate before the shuffle, so a hot
    key costs one row per map task), then grouped by source name. No joins.
    """
    names = list(others)
    tagged = [base.select(key, F.lit(0).alias("_src"))]
    tagged += [others[n].select(key, F.lit(i + 1).alias("_src")) for i, n in enumerate(names)]
    per_key = reduce(lambda a, b: a.unionByName(b), tagged).groupBy(key).agg(
        F.max(F.col("_src") == 0).alias("_in_base"),
        *[F.max(F.col("_src") == i + 1).alias(f"_in_{i + 1}") for i in range(len(names))],
    )
    long = per_key.select(
        "_in_base",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("source"), F.col(f"_in_{i + 1}").alias("_in_src"))
            for i, n in enumerate(names)
        ])).alias("_s"),
    )
    return long.groupBy(F.col("_s.source").alias("source")).agg(
        F.count_if("_in_base").cast("bigint").alias("base_keys"),
        F.count_if("_s._in_src").cast("bigint").alias("source_keys"),
        F.count_if(F.col("_in_base") & F.col("_s._in_src")).cast("bigint").alias("shared_keys"),
    )
