"""Audience restriction by bitmaps of the keys.

A set of whole-number keys is cut into buckets of 32 768 consecutive keys, each one bitmap of 4 KB
(``bitmap_construct_agg``): a key costs between a bit and 4 KB, depending on how close the keys
lie. Nine million keys in a row are 275 bitmaps, about 1 MB, where nine million rows of a hashed
relation are several hundred. The bitmaps are written once and their bytes measured; within the
broadcast bound they go to all executors, and the scan tests one bit per row, without a shuffle of
the log whatever its size or skew. Exact: no false positives.

Keys that lie far apart, or aren't whole numbers, take ``restrict_to_keys``'s way (broadcast of the
keys within the bound, else a shuffled semi join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..constants import KEY
from ..sources.files import stage
from .broadcast import maybe_broadcast
from .relational import restrict_to_keys

BUCKET = "_bucket"
BITS = "_bits"


def key_bitmaps(keys: DataFrame, key: str = KEY) -> DataFrame:
    """(bucket, bits): the set of non-null keys. One aggregate; a bucket's bitmap is built from
    partial ones, so repeated keys cost nothing in the shuffle."""
    number = F.col(key).cast("bigint")
    return keys.where(F.col(key).isNotNull()).groupBy(
        F.bitmap_bucket_number(number).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS))


def has_bit(bits: Column, number: Column) -> Column:
    """Whether the bitmap of ``number``'s bucket holds it."""
    place = F.bitmap_bit_position(number)
    byte = F.ascii(F.decode(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1)),
                            "ISO-8859-1"))
    return F.getbit(byte, (place % 8).cast("int")) == 1


def restrict_by_bitmap(df: DataFrame, keys: DataFrame, key: str = KEY,
                       max_broadcast_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``; a null key is in no set."""
    whole = all(isinstance(f.schema[key].dataType, IntegralType) for f in (df, keys))
    if not whole:
        return restrict_to_keys(df, keys, key, max_broadcast_bytes)
    bitmaps, small = maybe_broadcast(stage(key_bitmaps(keys, key), "key-bitmaps"),
                                     max_broadcast_bytes)
    if not small:
        return restrict_to_keys(df, keys, key, max_broadcast_bytes)
    number = F.col(key).cast("bigint")
    return df.join(bitmaps, (F.bitmap_bucket_number(number) == F.col(BUCKET))
                   & has_bit(F.col(BITS), number), "left_semi")
