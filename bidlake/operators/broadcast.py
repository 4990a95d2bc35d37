"""Size-checked broadcast.

A side is broadcast only when its measured bytes are within a bound; otherwise it gets no
hint, the planner shuffles both sides, and AQE may still broadcast at run time from measured
sizes. The bound defaults to ``FACTOR`` times the session's own broadcast threshold (0 when
that is off); the session conf ``bidlake.broadcast.maxBytes`` overrides it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: The session threshold guards unmeasured estimates; a measured side may be larger.
FACTOR = 4
#: Bytes of a row besides its values, in a hashed relation.
ROW_OVERHEAD = 24
#: Bytes taken for a text that isn't measured.
TEXT_GUESS = 64
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def parse_bytes(text: str) -> int:
    """Spark's size texts: ``10485760b``, ``256k``, ``1gb``, ``-1``."""
    text = text.strip().lower()
    if text.endswith("b") and len(text) > 1 and not text[-2].isdigit():
        text = text[:-1]
    unit = _UNITS.get(text[-1:])
    return int(text[:-1]) * unit if unit else int(text)


def broadcast_max_bytes(df: DataFrame) -> int:
    conf = df.sparkSession.conf
    own = conf.get("bidlake.broadcast.maxBytes", None)
    if own:
        return parse_bytes(own)
    return max(0, FACTOR * parse_bytes(conf.get("spark.sql.autoBroadcastJoinThreshold")))


def _is_text(kind: DataType) -> bool:
    return isinstance(kind, (StringType, BinaryType))


def _is_nested(kind: DataType) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType))


def measured_bytes(df: DataFrame) -> Column:
    """An aggregate: the bytes of all rows (texts and nested values measured, others 8)."""
    fixed = ROW_OVERHEAD + 8 * len(df.columns)
    total = F.count(F.lit(1)) * fixed
    for field in df.schema:
        name = F.col(f"`{field.name}`")
        if _is_text(field.dataType):
            total = total + F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
        elif _is_nested(field.dataType):
            total = total + F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(name)))), F.lit(0))
    return total


def guessed_width(df: DataFrame) -> int:
    """Bytes of a row when only rows are counted."""
    wide = sum(_is_text(f.dataType) or _is_nested(f.dataType) for f in df.schema)
    return ROW_OVERHEAD + 8 * len(df.columns) + TEXT_GUESS * wide


def maybe_broadcast(small: DataFrame, max_bytes: int | None = None,
                    bound: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Broadcast ``small`` only when its bytes are at most ``max_bytes``; otherwise return it
    unchanged.

    With ``bound``, a cheaper frame whose row count is an upper bound on ``small``'s (e.g. the
    dimension table that a one-row-per-key join result was built from), its rows times
    ``small``'s row width count instead. Never call this on a fact table: it is an action.
    """
    limit = broadcast_max_bytes(small) if max_bytes is None else max_bytes
    if limit <= 0:
        return small, False
    if bound is not None:
        size = bound.count() * guessed_width(small)
    else:
        size = small.agg(measured_bytes(small).alias("b")).first()["b"] or 0
    return (F.broadcast(small), True) if size <= limit else (small, False)
