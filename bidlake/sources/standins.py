"""Loaders that present the driver's test tables in the roles the workflow needs.

| role                          | table(s)                    | mapping                                   |
|-------------------------------|-----------------------------|-------------------------------------------|
| two yearly impression logs    | events, cut at 2024-01-16   | user_id -> ehhn, ts -> LogEntryTime,       |
|                               |                             | hour of week -> UserHourOfWeek             |
| campaign score                | customer, three segments    | c_custkey -> ehhn, c_acctbal -> ngr_score  |
| media-engagement snapshot     | orders of one year          | o_custkey -> ehhn (several rows per key)  |
| engagement score              | orders of one priority      | o_custkey -> ehhn                          |
| training frame                | lineitem, orders, part      | l_extendedprice -> MediaCostInBucks        |
| binary outcome                | labels, documents           | toxic / quality with document features    |

A negative account balance has no campaign score (null), which gives the null
handling real rows to act on; the test tables themselves hold no nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EVENT_TIME, KEY, SCORE, SOURCE_LABEL
from .files import read_parquet

# --- fixed values -------------------------------------------------------------
# Cut that splits the event log into an "older" and a "newer" yearly log.
LOG_CUTOVER = "2024-01-16 00:00:00"
# Campaign cohorts: three customer segments present at every scale.
COHORTS = ["BUILDING", "FURNITURE", "MACHINERY"]
# Snapshot year of the media-engagement stand-in.
SNAPSHOT_START = "1998-01-01 00:00:00"
SNAPSHOT_END = "1999-01-01 00:00:00"
# Priority whose customers form the engagement-score stand-in.
ENGAGED_PRIORITY = "1-URGENT"
# Categorical columns of the stand-in impression log and training frame.
LOG_CATEGORICALS = ["event_type", "prop_k"]
TRAINING_CATEGORICALS = ["l_returnflag", "l_linestatus", "p_brand", "p_type",
                         "o_orderpriority", "o_orderstatus"]
TRAINING_NUMERICS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice",
                     "o_totalprice"]
# Columns that make one lineitem row unique at every scale (split and order key).
TRAINING_ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
# --- end of fixed values -------------------------------------------------------


def ntz(ts: str):
    return F.expr(f"TIMESTAMP_NTZ '{ts}'")


def table(spark: SparkSession, sf_dir: str, name: str,
          columns: Sequence[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", columns)


def _log_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias(KEY),
        F.col("ts").alias(EVENT_TIME),
        F.col("event_type"),
        F.get_json_object("props", "$.k").alias("prop_k"),
        ((F.dayofweek("ts") - 1) * 24 + F.hour("ts")).alias("UserHourOfWeek"),
        F.col("value").alias("cost"),
    )


def impression_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two yearly impression logs. The newer one lists its columns in another order,
    as independently written yearly files may; the union must align them by name."""
    log = _log_projection(spark, sf_dir)
    older = log.where(F.col(EVENT_TIME) < ntz(LOG_CUTOVER))
    newer = log.where(F.col(EVENT_TIME) >= ntz(LOG_CUTOVER))
    return older, newer.select(*reversed(newer.columns))


def campaign_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign score per household for the three cohorts; key ``ehhn``, score ``ngr_score``."""
    cust = table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    return (
        cust.where(F.col("c_mktsegment").isin(COHORTS))
        .select(
            F.col("c_custkey").alias(KEY),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias(SCORE),
            F.col("c_mktsegment").alias("cohort"),
        )
    )


def media_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media-engagement snapshot: one year of orders, several rows per household."""
    orders = table(spark, sf_dir, "orders")
    return (
        orders.where((F.col("o_orderdate") >= ntz(SNAPSHOT_START))
                     & (F.col("o_orderdate") < ntz(SNAPSHOT_END)))
        .select(
            F.col("o_custkey").alias(KEY),
            "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority",
        )
    )


def engagement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority", "o_totalprice"])
    return (
        orders.where(F.col("o_orderpriority") == ENGAGED_PRIORITY)
        .select(F.col("o_custkey").alias(KEY), F.col("o_totalprice").alias("engagement"))
    )


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its order and part: categoricals, numerics, the cost label
    (``MediaCostInBucks``) and identifier/time columns that the exclusion list removes."""
    li = table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate"])
    orders = table(spark, sf_dir, "orders", [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    part = table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size",
                                          "p_retailprice"])
    joined = (li.join(orders, li.l_orderkey == orders.o_orderkey)
              .join(part, li.l_partkey == part.p_partkey))
    return joined.select(
        *TRAINING_ROW_KEY[:-1],
        F.col("o_custkey").alias(KEY),
        F.col("l_shipdate").alias(EVENT_TIME),
        *TRAINING_CATEGORICALS,
        *TRAINING_NUMERICS,
        F.col("l_extendedprice").alias(SOURCE_LABEL),
    )


def binary_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: features (``n_chars``, ``lang``, ``source``) and two 0/1
    outcomes, ``quality`` and the rarer ``toxic``."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    return labels.join(docs, "doc_id")
