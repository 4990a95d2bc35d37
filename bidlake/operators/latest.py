"""Latest row per key.

``row_number() over (partition by key order by time desc)`` kept at 1. Catalyst turns
the ``rn = 1`` filter into a WindowGroupLimit that runs once before the shuffle (each map
task keeps one row per key) and once after, so a household holding a third of all rows
costs one row per map task in the exchange, not a third of the data in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EVENT_TIME, KEY
from .broadcast import maybe_broadcast


def latest_order(time_col: str | Sequence[str],
                 tie_breaker: str | Sequence[str] | None) -> list:
    """Newest first by ``time_col`` (several columns: the first decides, then the next);
    null times last; ties broken by the greatest tie-breaker value.
    (The reference leaves ties arbitrary; a fixed tie-break makes reruns reproducible.)"""
    names: list[str] = []
    for part in (time_col, tie_breaker or ()):
        names += [part] if isinstance(part, str) else list(part)
    return [F.col(c).desc_nulls_last() for c in names]


def latest_per_key(df: DataFrame, key: str | Sequence[str] = KEY,
                   time_col: str | Sequence[str] = EVENT_TIME,
                   tie_breaker: str | Sequence[str] | None = None) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*latest_order(time_col, tie_breaker))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")


def latest_within_keys(df: DataFrame, keys: DataFrame, key: str = KEY,
                       time_col: str = EVENT_TIME, tie_breaker: str | Sequence[str] | None = None,
                       max_broadcast_bytes: int | None = None) -> DataFrame:
    """Latest row per key, for keys present in ``keys`` only (J1 + W2).

    Same rows in either order; the order is chosen by the size of ``keys``:
    * a key set proven small is broadcast and filters the rows map-side first, so less
      data is sorted for the window;
    * a large key set is applied after the window: the map-side group limit has already
      cut every key (hot ones included) to one row per task, and the semi join reuses the
      window's partitioning on ``key``, so only ``keys`` is shuffled.
    """
    keys = keys.select(key)
    small_keys, small = maybe_broadcast(keys, max_broadcast_bytes)
    if small:
        return latest_per_key(df.join(small_keys, key, "left_semi"), key, time_col, tie_breaker)
    return latest_per_key(df, key, time_col, tie_breaker).join(keys, key, "left_semi")
