"""Ordinal encoding of categorical columns.

Fit: every category of every column gets a code 1, 2, 3, ... in order of first
appearance, where "appearance order" is an explicit order key (Spark rows have no
inherent order). A null seen during the fit is a category like any other.
Transform: categories seen in the fit get their code, unseen ones ``-1``, and a null
that was not seen in the fit ``-2``.

The fitted mapping is a small table ``(scope..., feature, category, code)`` that is
written once and reused by training and scoring, so the same category has the same
code everywhere (the reference refits per frame; ``scope`` reproduces that when wanted).

Plan shape at scale:
* fit: unpivot -> partial+final hash aggregate to ``(feature, category, first_seen)``
  -> range-partitioned row numbers (no one-task window, even for a column with
  millions of categories);
* transform: one left join per column on that column's mapping. Mappings are broadcast,
  smallest first, while their measured bytes together stay within the bound; the others are
  shuffle-joined on the category and a salt, so a hot category (or null) goes to
  ``bidlake.encoding.salts`` tasks. AQE alone couldn't split it: it doesn't split a join
  that is fed by another join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NULL_CODE, UNKNOWN_CODE
from ..sources.files import stage, write_parquet
from .broadcast import broadcast_max_bytes, maybe_broadcast, measured_bytes
from .sequence import row_numbers

FEATURE = "feature"
CATEGORY = "category"
CODE = "code"
#: Tasks that one category's rows are dealt to when its mapping isn't broadcast.
SALTS = 16


@dataclass
class OrdinalEncoding:
    """A fitted mapping. ``mapping`` columns: ``*scope, feature, category, code``."""

    mapping: DataFrame
    columns: list[str]
    scope: list[str] = field(default_factory=list)
    # Bytes of each column's mapping, measured once on the staged mapping and reused by
    # every transform's broadcast decision.
    sizes: dict[str, int] | None = None

    def mapping_bytes(self) -> dict[str, int]:
        if self.sizes is None:
            self.sizes = {r[FEATURE]: r["b"] for r in self.mapping.groupBy(FEATURE)
                          .agg(measured_bytes(self.mapping).alias("b")).collect()}
        return self.sizes

    def transform(self, df: DataFrame, max_broadcast_bytes: int | None = None,
                  columns: Sequence[str] | None = None) -> DataFrame:
        return ordinal_transform(df, self, max_broadcast_bytes, columns)

    def save(self, path: str, mode: str = "errorifexists") -> str:
        write_parquet(self.mapping, path, mode=mode)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OrdinalEncoding:
        """Read a saved mapping; scope columns are the ones besides feature/category/code."""
        mapping = spark.read.parquet(path)
        scope = [c for c in mapping.columns if c not in (FEATURE, CATEGORY, CODE)]
        cols = [r[FEATURE] for r in mapping.select(FEATURE).distinct().orderBy(FEATURE).collect()]
        return cls(mapping, cols, scope)


def _first_seen(long: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """The least order values (``_ord0``, then ``_ord1`` among those rows, ...) of each
    category, as ``_first0``, ``_first1``, ...

    A minimum over a struct has no hash aggregate: it would sort all rows before the shuffle.
    So each column is a hash aggregate of its own, over the rows that have the least values
    so far; those values are a row per category, broadcast if that is small."""
    firsts = long.groupBy(*keys).agg(F.min("_ord0").alias("_first0"))
    for k in range(1, parts):
        least, _ = maybe_broadcast(firsts.select(
            *[F.col(c).alias(f"_k_{c}") for c in keys], *[f"_first{j}" for j in range(k)]))
        match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [
            F.col(f"_ord{j}").eqNullSafe(F.col(f"_first{j}")) for j in range(k)]
        firsts = long.join(least, match).groupBy(
            *keys, *[f"_first{j}" for j in range(k)]).agg(F.min(f"_ord{k}").alias(f"_first{k}"))
    return firsts


def ordinal_fit(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | str,
                scope: Sequence[str] = (), partitions: int | None = None,
                materialize: bool = True) -> OrdinalEncoding:
    """E1 (and E4 with ``scope``): codes from 1 in first-appearance order per column
    (per scope value). Ties on the order key are broken by the category text."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    scope = list(scope)
    long = df.select(
        *scope,
        *[F.col(c).alias(f"_ord{k}") for k, c in enumerate(order_by)],
        F.explode(F.array(*[
            F.struct(F.lit(c).alias(FEATURE), F.col(c).cast("string").alias(CATEGORY))
            for c in columns
        ])).alias("_kv"),
    ).select(*scope, *[f"_ord{k}" for k in range(len(order_by))], F.col(f"_kv.{FEATURE}").alias(FEATURE),
             F.col(f"_kv.{CATEGORY}").alias(CATEGORY))
    # Categories seen only on rows without an order value come last.
    firsts = _first_seen(long, [*scope, FEATURE, CATEGORY], len(order_by))
    ranked = row_numbers(firsts, [*[F.col(f"_first{k}").asc_nulls_last()
                                    for k in range(len(order_by))],
                                  F.col(CATEGORY).asc_nulls_first()], CODE,
                         group_cols=[*scope, FEATURE], partitions=partitions)
    mapping = ranked.select(*scope, FEATURE, CATEGORY, F.col(CODE).cast("int").alias(CODE))
    if materialize:
        # Written once to the shared staging folder: every per-column join and every later
        # transform reads the small table instead of re-running the fit.
        mapping = stage(mapping, "ordinal-mapping")
    return OrdinalEncoding(mapping, list(columns), scope)


def ordinal_transform(df: DataFrame, enc: OrdinalEncoding,
                      max_broadcast_bytes: int | None = None,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Replace each encoded column (or only ``columns``) by its integer code.

    ``max_broadcast_bytes`` bounds all broadcast mappings of one transform together (default
    ``bidlake.encoding.maxBroadcastBytes``, else the general broadcast bound).
    """
    conf = df.sparkSession.conf
    left = max_broadcast_bytes
    if left is None:
        own = conf.get("bidlake.encoding.maxBroadcastBytes", None)
        left = int(own) if own else broadcast_max_bytes(df)
    salts = int(conf.get("bidlake.encoding.salts", str(SALTS)))
    targets = list(enc.columns if columns is None else columns)
    unknown = [c for c in targets if c not in enc.columns]
    if unknown:
        raise ValueError(f"encoding has no mapping for {unknown}")
    missing = [c for c in targets + enc.scope if c not in df.columns]
    if missing:
        raise ValueError(f"frame lacks encoded columns {missing}")
    sizes = enc.mapping_bytes()
    small = set()
    for c in sorted(targets, key=lambda c: sizes.get(c, 0)):
        left -= sizes.get(c, 0)
        if left >= 0:
            small.add(c)
    out = df
    for c in targets:
        m = enc.mapping.where(F.col(FEATURE) == c).select(
            *[F.col(s).alias(f"_m_{s}") for s in enc.scope],
            F.col(CATEGORY).alias("_m_cat"), F.col(CODE).alias("_m_code"))
        cond = F.col(c).cast("string").eqNullSafe(F.col("_m_cat"))
        for s in enc.scope:
            cond = cond & F.col(s).eqNullSafe(F.col(f"_m_{s}"))
        if c in small:
            m = F.broadcast(m)
            rows = out
        else:
            m = m.withColumn("_m_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            rows = out.withColumn("_salt", F.pmod(F.xxhash64(*map(F.col, df.columns)),
                                                  F.lit(salts)).cast("int"))
            cond = cond & (F.col("_salt") == F.col("_m_salt"))
        joined = rows.join(m, cond, "left")
        code = (F.when(F.col("_m_code").isNotNull(), F.col("_m_code"))
                .when(F.col(c).isNull(), F.lit(NULL_CODE))
                .otherwise(F.lit(UNKNOWN_CODE)))
        out = joined.select(*[code.alias(c) if x == c else F.col(x) for x in out.columns])
    return out


def ordinal_fit_transform(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | str,
                          scope: Sequence[str] = ()) -> tuple[DataFrame, OrdinalEncoding]:
    enc = ordinal_fit(df, columns, order_by, scope)
    return enc.transform(df), enc
