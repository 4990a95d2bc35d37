"""Registered queries over the driver's tables and their DuckDB twins.

Each entry of ``QUERIES`` is ``f(spark, sf_dir) -> DataFrame`` running over whole tables;
``ORACLE_SQL`` holds, under the same key, SQL that DuckDB evaluates on the same parquet
files (views named after the tables). Column names match between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import (
    BID_COLUMN,
    CONVERSION_COLUMN,
    EVENT_TIME,
    EXCLUDED_TRAINING_COLUMNS,
    KEY,
    LABEL,
    SCORE,
    SHIFT_BASE,
    SOURCE_KEY,
    SOURCE_LABEL,
    SOURCE_SCORE,
)
from .functions.metrics import (
    agreement_metrics,
    average_precision,
    error_metrics,
    log_loss,
    median_error,
    pr_curve,
    regression_metrics,
    roc_auc,
    threshold_metrics,
)
from .operators.bitmap import restrict_by_bitmap
from .operators.broadcast import maybe_broadcast
from .operators.encoding import ordinal_fit
from .operators.impute import impute
from .operators.latest import latest_per_key
from .operators.relational import (
    distinct_keys,
    drop_incomplete,
    exclude_columns,
    join_on_key,
    key_coverage,
    rename_columns,
    restrict_to_keys,
)
from .operators.similarity import top_similar
from .operators.split import (
    SPLIT,
    TEST,
    TRAIN,
    VALIDATION,
    exact_sample,
    exact_split,
    features_and_label,
    hash_split,
    label_shift,
    shift_value,
)
from .operators.target_stats import ordered_target_statistics
from .models.ensemble import fit_ensemble
from .models.score import load_model
from .models.train import PREDICTION, save_model
from .plans import features, scoring, training
from .plans.report import conversion_share, score_bins
from .session import run_stamp_column, stage_path
from .streaming import admission, realtime, stateful
from .sources import standins
from .sources.files import (
    latest_partition,
    read_cohorts,
    read_csv,
    read_partition,
    stage,
    write_csv,
    write_parquet,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------------
# SQL building blocks (DuckDB) mirroring the stand-in loaders.
# ---------------------------------------------------------------------------------
_LOG_SELECT = (
    "SELECT event_id, user_id AS ehhn, ts AS LogEntryTime, event_type, "
    "json_extract_string(props, '$.k') AS prop_k, "
    "CAST(dayofweek(ts) * 24 + hour(ts) AS INTEGER) AS UserHourOfWeek, value AS cost FROM events"
)
SQL_LOG = (
    f"{_LOG_SELECT} WHERE ts < TIMESTAMP '2024-01-16 00:00:00' "
    f"UNION ALL {_LOG_SELECT} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'"
)
SQL_SCORES = (
    "SELECT c_custkey AS ehhn, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS ngr_score, "
    "c_mktsegment AS cohort FROM customer "
    "WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY')"
)
SQL_MEDIA = (
    "SELECT o_custkey AS ehhn, o_orderkey, o_orderdate, o_totalprice, o_orderstatus, "
    "o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' "
    "AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'"
)
SQL_ENGAGEMENT = (
    "SELECT o_custkey AS ehhn, o_totalprice AS engagement FROM orders "
    "WHERE o_orderpriority = '1-URGENT'"
)
SQL_LATEST = f"""
    SELECT * FROM ({SQL_LOG}) lg
    WHERE ehhn IN (SELECT ehhn FROM ({SQL_SCORES}) s)
    QUALIFY row_number() OVER (PARTITION BY ehhn
        ORDER BY LogEntryTime DESC NULLS LAST, event_id DESC NULLS LAST) = 1
"""
SQL_RAW_FEATURES = f"""
    SELECT l.ehhn, l.event_id, l.LogEntryTime, l.event_type, l.prop_k, l.UserHourOfWeek,
           l.cost, s.ngr_score, s.cohort, m.o_orderkey, m.o_orderdate, m.o_totalprice,
           m.o_orderstatus, m.o_orderpriority
    FROM ({SQL_LATEST}) l
    JOIN ({SQL_SCORES}) s ON l.ehhn = s.ehhn
    JOIN ({SQL_MEDIA}) m ON l.ehhn = m.ehhn
    WHERE l.ehhn IS NOT NULL AND l.event_id IS NOT NULL AND l.LogEntryTime IS NOT NULL
      AND l.event_type IS NOT NULL AND l.prop_k IS NOT NULL AND l.UserHourOfWeek IS NOT NULL
      AND l.cost IS NOT NULL AND NOT isnan(l.cost)
      AND s.ngr_score IS NOT NULL AND NOT isnan(s.ngr_score) AND s.cohort IS NOT NULL
      AND m.o_orderkey IS NOT NULL AND m.o_orderdate IS NOT NULL
      AND m.o_totalprice IS NOT NULL AND NOT isnan(m.o_totalprice)
      AND m.o_orderstatus IS NOT NULL AND m.o_orderpriority IS NOT NULL
"""


def sql_ordinal_mapping(source: str, columns: list[str], order_key: str,
                        scope: list[str] | None = None) -> str:
    """Mapping (scope..., feature, category, code): codes from 1 by first appearance."""
    scope = scope or []
    sc = "".join(f"{s}, " for s in scope)
    parts = " UNION ALL ".join(
        f"SELECT {sc}'{c}' AS feature, CAST({c} AS VARCHAR) AS category, {order_key} AS ord "
        f"FROM src" for c in columns)
    part_by = ", ".join([*scope, "feature"])
    return f"""
        WITH src AS ({source}), lng AS ({parts})
        SELECT {sc}feature, category,
               CAST(row_number() OVER (PARTITION BY {part_by}
                    ORDER BY min(ord) NULLS LAST, category NULLS FIRST) AS INTEGER) AS code
        FROM lng GROUP BY {sc}feature, category
    """


def sql_ordinal_transform(source: str, all_columns: list[str], encoded: list[str],
                          mapping: str, scope: list[str] | None = None) -> str:
    scope = scope or []
    sel, joins = [], []
    for c in all_columns:
        if c in encoded:
            a = f"m_{c}"
            sel.append(f"CAST(COALESCE({a}.code, CASE WHEN t.{c} IS NULL THEN -2 ELSE -1 END) "
                       f"AS INTEGER) AS {c}")
            cond = " AND ".join([f"{a}.feature = '{c}'",
                                 f"{a}.category IS NOT DISTINCT FROM CAST(t.{c} AS VARCHAR)"]
                                + [f"{a}.{s} IS NOT DISTINCT FROM t.{s}" for s in scope])
            joins.append(f"LEFT JOIN mp {a} ON {cond}")
        else:
            sel.append(f"t.{c}")
    return (f"WITH t AS ({source}), mp AS ({mapping}) SELECT {', '.join(sel)} FROM t "
            + " ".join(joins))


_RAW_COLUMNS = ["ehhn", "event_id", "LogEntryTime", "event_type", "prop_k", "UserHourOfWeek",
                "cost", "ngr_score",
                "cohort", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus",
                "o_orderpriority"]


# ---------------------------------------------------------------------------------
# Feature extraction slice: U1 P1 U2 J1 W1 W2 F1 P7 J2 J3 P8 F3 E1 E2
# ---------------------------------------------------------------------------------
@register("feature_vectors", sql_ordinal_transform(
    SQL_RAW_FEATURES, _RAW_COLUMNS, features.FEATURE_CATEGORICALS,
    sql_ordinal_mapping("SELECT * FROM t", features.FEATURE_CATEGORICALS,
                        features.FEATURE_ORDER_KEY)))
def q_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_vectors(spark, sf_dir)


@register("union_logs", SQL_LOG)
def q_union_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.impression_log(spark, sf_dir)


@register("audience_intersect", f"SELECT ehhn FROM ({SQL_LOG}) INTERSECT "
                                f"SELECT ehhn FROM ({SQL_SCORES})")
def q_audience_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.audience_keys(spark, sf_dir)


@register("audience_semi_join", f"SELECT * FROM ({SQL_LOG}) lg "
                                f"WHERE ehhn IN (SELECT ehhn FROM ({SQL_SCORES}))")
def q_audience_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = features.impression_log(spark, sf_dir)
    return restrict_to_keys(log, standins.campaign_scores(spark, sf_dir))


@register("audience_bitmap", f"SELECT * FROM ({SQL_LOG}) lg "
                             f"WHERE ehhn IN (SELECT ehhn FROM ({SQL_SCORES}))")
def q_audience_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audience restriction by bitmaps of the keys, one bit tested per impression."""
    log = features.impression_log(spark, sf_dir)
    return restrict_by_bitmap(log, standins.campaign_scores(spark, sf_dir))


@register("campaign_similarity", """
    WITH w AS (SELECT l_suppkey AS campaign, l_partkey AS d, sum(l_quantity)::DOUBLE AS w
               FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0),
    n AS (SELECT campaign, sum(w * w) AS n FROM w GROUP BY campaign),
    p AS (SELECT a.campaign, b.campaign AS other, sum(a.w * b.w) AS dot
          FROM w a JOIN w b ON a.d = b.d AND a.campaign <> b.campaign GROUP BY ALL)
    SELECT campaign, row_number() OVER (PARTITION BY campaign
               ORDER BY dot / sqrt(n.n * o.n) DESC, other)::INT AS rank,
           other, round(dot / sqrt(n.n * o.n), 9) AS similarity
    FROM p JOIN n USING (campaign) JOIN (SELECT campaign AS other, n FROM n) o USING (other)
    QUALIFY rank <= 5""")
def q_campaign_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the five most similar campaigns of each, suppliers standing in for campaigns and
    the quantities of their parts for weights."""
    sold = standins.table(spark, sf_dir, "lineitem", ["l_suppkey", "l_partkey", "l_quantity"])
    return top_similar(sold, 5, "l_suppkey", "l_partkey", "l_quantity").select(
        F.col("l_suppkey").alias("campaign"), "rank", "other",
        F.round("similarity", 9).alias("similarity"))


@register("distinct_keys", "SELECT DISTINCT o_custkey AS ehhn FROM orders")
def q_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = standins.table(spark, sf_dir, "orders", ["o_custkey"])
    return distinct_keys(rename_columns(orders, {"o_custkey": KEY}))


SQL_LATEST_ALL = f"""
    SELECT * FROM ({SQL_LOG}) lg QUALIFY row_number() OVER (PARTITION BY ehhn
        ORDER BY LogEntryTime DESC NULLS LAST, event_id DESC NULLS LAST) = 1
"""


@register("latest_per_key", SQL_LATEST_ALL)
def q_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest impression of every household in the log."""
    return latest_per_key(features.impression_log(spark, sf_dir), KEY, EVENT_TIME, "event_id")


@register("latest_in_audience", SQL_LATEST)
def q_latest_in_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_impressions(spark, sf_dir)


@register("join_scores", f"SELECT l.*, s.ngr_score, s.cohort FROM ({SQL_LATEST}) l "
                         f"JOIN ({SQL_SCORES}) s ON l.ehhn = s.ehhn")
def q_join_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = features.latest_impressions(spark, sf_dir)
    scores = standins.campaign_scores(spark, sf_dir).select(KEY, SCORE, "cohort")
    return join_on_key(latest, scores)


@register("join_fanout_latest", f"""
    SELECT l.*, m.o_orderkey, m.o_orderdate, m.o_totalprice, m.o_orderstatus, m.o_orderpriority
    FROM ({SQL_LATEST}) l JOIN (
        SELECT * FROM ({SQL_MEDIA}) QUALIFY row_number() OVER (PARTITION BY ehhn
            ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1
    ) m ON l.ehhn = m.ehhn""")
def q_join_fanout_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = features.latest_impressions(spark, sf_dir)
    media = standins.media_engagement(spark, sf_dir)
    return join_on_key(latest, media, on_duplicate="latest", order_by=["o_orderdate"],
                       tie_breaker="o_orderkey")


@register("join_fanout_keep", f"""
    SELECT l.*, m.o_orderkey, m.o_orderdate, m.o_totalprice, m.o_orderstatus, m.o_orderpriority
    FROM ({SQL_LATEST}) l JOIN ({SQL_MEDIA}) m ON l.ehhn = m.ehhn""")
def q_join_fanout_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = features.latest_impressions(spark, sf_dir)
    return join_on_key(latest, standins.media_engagement(spark, sf_dir))


# Every customer; a negative balance has no score, which makes real nulls.
SQL_ALL_SCORES = (
    "SELECT c_custkey AS ehhn, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS ngr_score, "
    "c_mktsegment AS cohort FROM customer"
)


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every customer, keyed as delivered (``HSHD_CODE``, ``campaign_score``) and
    brought to the library's names."""
    delivered = standins.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(SOURCE_KEY),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias(SOURCE_SCORE),
        F.col("c_mktsegment").alias("cohort"))
    return features.campaign_scores_from_source(delivered)


@register("keyed_source", SQL_ALL_SCORES)
def q_keyed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key and score renamed from their source names."""
    return all_scores(spark, sf_dir)


@register("drop_incomplete", f"SELECT * FROM ({SQL_ALL_SCORES}) WHERE ehhn IS NOT NULL AND "
                             f"ngr_score IS NOT NULL AND NOT isnan(ngr_score) AND cohort IS NOT NULL")
def q_drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_incomplete(all_scores(spark, sf_dir))


# Two order columns: the first has few values, so the second decides; ties go to the key.
@register("join_fanout_latest_two", f"""
    SELECT l.*, m.o_orderkey, m.o_orderdate, m.o_totalprice, m.o_orderstatus, m.o_orderpriority
    FROM ({SQL_LATEST_ALL}) l JOIN (
        SELECT o_custkey AS ehhn, o_orderkey, o_orderdate, o_totalprice, o_orderstatus,
               o_orderpriority FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderpriority DESC NULLS LAST, o_orderdate DESC NULLS LAST,
                     o_orderkey DESC NULLS LAST) = 1
    ) m ON l.ehhn = m.ehhn""")
def q_join_fanout_latest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = standins.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(KEY), "o_orderkey", "o_orderdate", "o_totalprice",
        "o_orderstatus", "o_orderpriority")
    return join_on_key(q_latest_per_key(spark, sf_dir), orders, on_duplicate="latest",
                       order_by=["o_orderpriority", "o_orderdate"], tie_breaker="o_orderkey")


@register("raw_feature_vectors", SQL_RAW_FEATURES)
def q_raw_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.raw_feature_vectors(spark, sf_dir)


@register("key_coverage", f"""
    WITH base AS (SELECT DISTINCT ehhn FROM ({SQL_LATEST})),
    src AS (
        SELECT 'ngr' AS source, ehhn FROM ({SQL_SCORES})
        UNION ALL SELECT 'all', ehhn FROM ({SQL_ALL_SCORES})
        UNION ALL SELECT 'ord', o_custkey FROM orders
        UNION ALL SELECT 'med', ehhn FROM ({SQL_MEDIA})
        UNION ALL SELECT 'fsb', ehhn FROM ({SQL_ENGAGEMENT})),
    srck AS (SELECT DISTINCT source, ehhn FROM src),
    names AS (SELECT DISTINCT source FROM src)
    SELECT n.source,
        CAST((SELECT count(*) FROM base) AS BIGINT) AS base_keys,
        CAST((SELECT count(*) FROM srck k WHERE k.source = n.source) AS BIGINT) AS source_keys,
        CAST((SELECT count(*) FROM srck k JOIN base b ON k.ehhn IS NOT DISTINCT FROM b.ehhn
              WHERE k.source = n.source) AS BIGINT) AS shared_keys
    FROM names n""")
def q_key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The households of the latest-impression table are exactly the audience households
    # of the log: taking their keys from the restricted log needs no window (no sort).
    scores = standins.campaign_scores(spark, sf_dir)
    audience_log = restrict_to_keys(features.impression_log(spark, sf_dir).select(KEY), scores)
    return key_coverage(audience_log, {
        "ngr": scores,
        "all": all_scores(spark, sf_dir),
        "ord": standins.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias(KEY)),
        "med": standins.media_engagement(spark, sf_dir),
        "fsb": standins.engagement_scores(spark, sf_dir),
    })


# ---------------------------------------------------------------------------------
# Encoding: E1 E2 E3 E4 on the lineitem training stand-in, household rows and the log
# ---------------------------------------------------------------------------------
SQL_TRAINING_FRAME = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS ehhn,
           l_shipdate AS LogEntryTime, l_returnflag, l_linestatus, p_brand, p_type,
           o_orderpriority, o_orderstatus, l_quantity, l_discount, l_tax, p_size,
           p_retailprice, o_totalprice, l_extendedprice AS MediaCostInBucks
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""
_TRAINING_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ehhn",
                     "LogEntryTime", *standins.TRAINING_CATEGORICALS, *standins.TRAINING_NUMERICS,
                     "MediaCostInBucks"]
TRAINING_ORDER_KEY = "l_orderkey"


@register("ordinal_fit", sql_ordinal_mapping(SQL_TRAINING_FRAME, standins.TRAINING_CATEGORICALS,
                                             TRAINING_ORDER_KEY))
def q_ordinal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = standins.training_frame(spark, sf_dir)
    return ordinal_fit(tf, standins.TRAINING_CATEGORICALS, TRAINING_ORDER_KEY).mapping


@register("ordinal_transform", sql_ordinal_transform(
    SQL_TRAINING_FRAME, _TRAINING_COLUMNS, standins.TRAINING_CATEGORICALS,
    sql_ordinal_mapping("SELECT * FROM t", standins.TRAINING_CATEGORICALS, TRAINING_ORDER_KEY)))
def q_ordinal_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = standins.training_frame(spark, sf_dir)
    enc = ordinal_fit(tf, standins.TRAINING_CATEGORICALS, TRAINING_ORDER_KEY)
    return enc.transform(tf)


@register("ordinal_fit_by_cohort", sql_ordinal_mapping(
    SQL_RAW_FEATURES, features.FEATURE_CATEGORICALS, features.FEATURE_ORDER_KEY, ["cohort"]))
def q_ordinal_fit_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = features.raw_feature_vectors(spark, sf_dir)
    return ordinal_fit(raw, features.FEATURE_CATEGORICALS, features.FEATURE_ORDER_KEY,
                       scope=["cohort"]).mapping


@register("ordinal_transform_by_cohort", sql_ordinal_transform(
    SQL_RAW_FEATURES, _RAW_COLUMNS, features.FEATURE_CATEGORICALS, sql_ordinal_mapping(
        "SELECT * FROM t", features.FEATURE_CATEGORICALS, features.FEATURE_ORDER_KEY, ["cohort"]),
    ["cohort"]))
def q_ordinal_transform_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cohort encoded with its own mapping."""
    raw = features.raw_feature_vectors(spark, sf_dir)
    return ordinal_fit(raw, features.FEATURE_CATEGORICALS, features.FEATURE_ORDER_KEY,
                       scope=["cohort"]).transform(raw)


_LOG_COLUMNS = list(features.LOG_COLUMNS)
_SQL_GAPPED_LOG = f"""
    SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN prop_k END AS prop_k) FROM ({SQL_LOG})"""


@register("ordinal_unknown", sql_ordinal_transform(
    _SQL_GAPPED_LOG, _LOG_COLUMNS, standins.LOG_CATEGORICALS,
    sql_ordinal_mapping("SELECT * FROM t WHERE CAST(prop_k AS INTEGER) % 7 <> 0",
                        standins.LOG_CATEGORICALS, "event_id")))
def q_ordinal_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row's ``prop_k`` is null; the fit sees neither nulls nor multiples of
    7, so the transform gives -2 and -1 to them."""
    log = features.impression_log(spark, sf_dir).withColumn(
        "prop_k", F.when(F.col("event_id") % 10 != 0, F.col("prop_k")))
    enc = ordinal_fit(log.where(F.col("prop_k").cast("int") % 7 != 0),
                      standins.LOG_CATEGORICALS, "event_id")
    return enc.transform(log)


# ---------------------------------------------------------------------------------
# Split, exclusion, label shift: T2 T3 P4 P6 P9 P11 P12
# ---------------------------------------------------------------------------------
SPLIT_SEED = 42
_KEY_SQL = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "CAST(MediaCostInBucks AS DECIMAL(18,2))"))
_SPLIT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "MediaCostInBucks"]
_SQL_HASHED = f"SELECT *, md5(concat_ws('|', '{SPLIT_SEED}', {_KEY_SQL})) AS h FROM ({SQL_TRAINING_FRAME})"


def _money_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training frame with the cost as money, whose text is the same in every engine."""
    return standins.training_frame(spark, sf_dir).withColumn(
        SOURCE_LABEL, F.col(SOURCE_LABEL).cast("decimal(18,2)"))


def _split_case(pos: str, a: str, b: str) -> str:
    return f"CASE WHEN {pos} < {a} THEN 'train' WHEN {pos} < {b} THEN 'validation' ELSE 'test' END"


@register("hash_split", f"""
    SELECT {', '.join(_SPLIT_KEY)},
        {_split_case("CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 100", "60", "80")} AS split
    FROM ({_SQL_HASHED})""")
def q_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = hash_split(_money_keyed(spark, sf_dir), _SPLIT_KEY, SPLIT_SEED)
    return split.select(*_SPLIT_KEY, "split").withColumn(
        SOURCE_LABEL, F.col(SOURCE_LABEL).cast("double"))


@register("exact_split", f"""
    SELECT {', '.join(_SPLIT_KEY)},
        CASE WHEN rn <= (n * 60) // 100 THEN 'train' WHEN rn <= (n * 80) // 100 THEN 'validation'
             ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY h, {', '.join(_SPLIT_KEY)}) AS rn,
                 count(*) OVER () AS n FROM ({_SQL_HASHED}))""")
def q_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = _money_keyed(spark, sf_dir).select(*_SPLIT_KEY)
    return exact_split(narrow, _SPLIT_KEY, SPLIT_SEED).withColumn(
        SOURCE_LABEL, F.col(SOURCE_LABEL).cast("double"))


@register("exclude_columns", "SELECT * EXCLUDE (ehhn, LogEntryTime) FROM (" + SQL_TRAINING_FRAME + ")")
def q_exclude_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclude_columns(standins.training_frame(spark, sf_dir), EXCLUDED_TRAINING_COLUMNS)


_U = shift_value(SPLIT_SEED)


#: Rows of each class in the exact sample: conversions are rare.
SAMPLE_SIZES = {1: 400, 0: 800}


@register("exact_sample", f"""
    SELECT event_id, ehhn, (event_type = 'purchase')::INT AS converted FROM ({SQL_LOG})
    QUALIFY row_number() OVER (PARTITION BY event_type = 'purchase' ORDER BY
        ('0x' || substr(md5('{training.DEFAULT_SEED}|=' || event_id::VARCHAR), 1, 13))::BIGINT,
        event_id) <= CASE WHEN event_type = 'purchase' THEN {SAMPLE_SIZES[1]}
                          ELSE {SAMPLE_SIZES[0]} END""")
def q_exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly so many impressions of each class, whatever the imbalance."""
    log = features.impression_log(spark, sf_dir).select(
        "event_id", KEY, F.coalesce(F.col("event_type") == "purchase", F.lit(False)).cast("int")
        .alias("converted"))
    return exact_sample(log, "converted", SAMPLE_SIZES, ["event_id"], training.DEFAULT_SEED)


@register("label_shift", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(MediaCostInBucks AS DOUBLE) - CAST('{SHIFT_BASE!r}' AS DOUBLE)
            + CAST('{_U!r}' AS DOUBLE) AS biddingprice
    FROM ({SQL_TRAINING_FRAME})""")
def q_label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = rename_columns(standins.training_frame(spark, sf_dir), {SOURCE_LABEL: LABEL})
    shifted = label_shift(tf, LABEL, _U)
    return shifted.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", LABEL)


@register("label_from_text", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(CAST(CAST(MediaCostInBucks AS DECIMAL(18,2)) AS VARCHAR) AS DOUBLE)
            - CAST('{SHIFT_BASE!r}' AS DOUBLE) + CAST('{_U!r}' AS DOUBLE) AS biddingprice
    FROM ({SQL_TRAINING_FRAME})""")
def q_label_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label delivered as text is cast before the shift."""
    text = _money_keyed(spark, sf_dir).withColumn(SOURCE_LABEL, F.col(SOURCE_LABEL).cast("string"))
    shifted = label_shift(rename_columns(text, {SOURCE_LABEL: LABEL}), LABEL, _U)
    return shifted.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", LABEL)


# Impression-level training rows (the frame the bid model is trained on).
SQL_MEDIA_LATEST = f"""
    SELECT * FROM ({SQL_MEDIA}) QUALIFY row_number() OVER (PARTITION BY ehhn
        ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1"""
SQL_BID_ROWS = f"""
    SELECT lg.event_id AS ImpressionId, lg.ehhn, lg.LogEntryTime, lg.event_type, lg.prop_k,
           lg.UserHourOfWeek,
           s.ngr_score, s.cohort, m.o_totalprice, m.o_orderstatus, m.o_orderpriority,
           CASE WHEN lg.event_type = 'purchase' THEN 1 ELSE 0 END AS converted,
           lg.cost AS MediaCostInBucks
    FROM ({SQL_LOG}) lg
    JOIN ({SQL_SCORES}) s ON lg.ehhn = s.ehhn
    JOIN ({SQL_MEDIA_LATEST}) m ON lg.ehhn = m.ehhn
    WHERE lg.event_id IS NOT NULL AND lg.ehhn IS NOT NULL AND lg.LogEntryTime IS NOT NULL
      AND lg.event_type IS NOT NULL AND lg.prop_k IS NOT NULL AND lg.UserHourOfWeek IS NOT NULL
      AND s.ngr_score IS NOT NULL AND NOT isnan(s.ngr_score) AND s.cohort IS NOT NULL
      AND m.o_totalprice IS NOT NULL AND NOT isnan(m.o_totalprice)
      AND m.o_orderstatus IS NOT NULL AND m.o_orderpriority IS NOT NULL
      AND lg.cost IS NOT NULL AND NOT isnan(lg.cost)"""
_BID_ROW_COLUMNS = ["ImpressionId", "ehhn", "LogEntryTime", "event_type", "prop_k",
                    "UserHourOfWeek", "ngr_score",
                    "cohort", "o_totalprice", "o_orderstatus", "o_orderpriority", "converted",
                    "MediaCostInBucks", "split"]
_SQL_BID_SPLIT = f"""
    SELECT *, {_split_case(
        "CAST(('0x' || substr(md5(concat_ws('|', '{0}', '=' || CAST(ImpressionId AS VARCHAR))), 1, 8))"
        " AS BIGINT) % 100".format(training.DEFAULT_SEED), "60", "80")} AS split
    FROM ({SQL_BID_ROWS})"""
_U_BID = shift_value(training.DEFAULT_SEED)


@register("prepared_training", f"""
    SELECT split, event_type, prop_k, UserHourOfWeek, ngr_score, cohort, o_totalprice,
           o_orderstatus,
           o_orderpriority, converted,
           CAST(MediaCostInBucks AS DOUBLE) - CAST('{SHIFT_BASE!r}' AS DOUBLE)
               + CAST('{_U_BID!r}' AS DOUBLE) AS biddingprice
    FROM ({sql_ordinal_transform(
        _SQL_BID_SPLIT, _BID_ROW_COLUMNS, training.BID_CATEGORICALS,
        sql_ordinal_mapping("SELECT * FROM t", training.BID_CATEGORICALS, "ImpressionId"))})""")
def q_prepared_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.bid_training_rows(spark, sf_dir)
    prepared, _ = training.prepare_training(rows, training.BID_CATEGORICALS, training.ROW_ID,
                                            training.DEFAULT_SEED)
    return prepared


# Ordered target statistics: the window holds the rows before; other rows see all training rows.
_SQL_STATISTICS = " UNION ALL ".join(
    f"SELECT ImpressionId, split, '{c}' AS feature, {c} AS category, MediaCostInBucks AS y "
    f"FROM r" for c in training.BID_CATEGORICALS)


@register("target_statistics", f"""
    WITH r AS MATERIALIZED ({_SQL_BID_SPLIT}),
    p AS (SELECT avg(y) AS p FROM (SELECT MediaCostInBucks AS y FROM r WHERE split = 'train')),
    l AS ({_SQL_STATISTICS}),
    a AS (SELECT feature, category, sum(y) AS s, count(y) AS n FROM l WHERE split = 'train'
          GROUP BY ALL),
    v AS (
      SELECT ImpressionId, split, feature, (coalesce(sum(y) OVER w, 0) + p) / (count(y) OVER w + 1)
               AS v FROM l, p WHERE split = 'train'
      WINDOW w AS (PARTITION BY feature, category
          ORDER BY md5('{training.DEFAULT_SEED}|=' || ImpressionId::VARCHAR), ImpressionId
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      UNION ALL SELECT ImpressionId, split, feature, (coalesce(s, 0) + p) / (coalesce(n, 0) + 1)
      FROM p, l LEFT JOIN a USING (feature, category) WHERE split <> 'train')
    SELECT ImpressionId, split, {", ".join(
        f"round(max(v) FILTER (feature = '{c}'), 9) AS {c}_ts" for c in training.BID_CATEGORICALS)}
    FROM v GROUP BY ImpressionId, split""")
def q_target_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 CAT: each categorical as the mean cost of the rows before (training rows), or of all
    training rows (the others)."""
    rows = stage(hash_split(training.bid_training_rows(spark, sf_dir), [training.ROW_ID],
                            training.DEFAULT_SEED), "statistics-rows")
    ordered, stats = ordered_target_statistics(
        rows.where(F.col(SPLIT) == TRAIN), training.BID_CATEGORICALS, SOURCE_LABEL,
        training.ROW_ID, training.DEFAULT_SEED)
    every = ordered.unionByName(stats.transform(rows.where(F.col(SPLIT) != TRAIN)))
    return every.select(training.ROW_ID, SPLIT, *[
        F.round(f"{c}_ts", 9).alias(f"{c}_ts") for c in training.BID_CATEGORICALS])


@register("test_features", f"""
    SELECT * EXCLUDE (split, biddingprice) FROM ({ORACLE_SQL["prepared_training"]})
    WHERE split = 'test'""")
def q_test_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out split's feature matrix (label removed); its label vector is the
    other half of ``features_and_label``."""
    prepared = q_prepared_training(spark, sf_dir)
    test = prepared.where(F.col(SPLIT) == TEST).drop(SPLIT)
    feats, _label = features_and_label(test, LABEL)
    return feats


# ---------------------------------------------------------------------------------
# Metrics: X1-X8 on deterministic predictions derived from the tables
# ---------------------------------------------------------------------------------
def _sql_regression(scale: str, places_r2: int, mse: str) -> str:
    return f"""
    WITH t AS (
        SELECT l_returnflag, l_extendedprice / {scale} AS y,
               avg(l_extendedprice / {scale}) OVER (PARTITION BY p_brand) AS p
        FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_missing,
        round(CASE WHEN var_pop(y) * count(y) > 0
              THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) END, {places_r2}) AS r2,
        {mse.format("sum((y - p) * (y - p)) / count(*)")} AS mse
    FROM t GROUP BY l_returnflag"""


def brand_baseline(spark: SparkSession, sf_dir: str, scale: float) -> DataFrame:
    """Item prices (over ``scale``) with the mean of their brand as prediction. The joined
    rows are written once and read twice; the brand means are joined by size check."""
    li = standins.table(spark, sf_dir, "lineitem", ["l_partkey", "l_extendedprice", "l_returnflag"])
    part = standins.table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    rows = stage(li.join(part, li.l_partkey == part.p_partkey).select(
        "l_returnflag", "p_brand", (F.col("l_extendedprice") / scale).alias("y")), "priced")
    means, _ = maybe_broadcast(rows.groupBy("p_brand").agg(F.avg("y").alias("p")))
    return rows.join(means, "p_brand")


@register("metric_regression", _sql_regression("1.0", 9, "round({}, 2)"))
def q_metric_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R^2 and MSE of a brand-mean baseline price, per return flag."""
    out = regression_metrics(brand_baseline(spark, sf_dir, 1.0), "y", "p", ["l_returnflag"])
    return out.withColumns({"r2": F.round("r2", 9), "mse": F.round("mse", 2)})


@register("metric_regression_bid_scale", _sql_regression("1e7", 9, "round({} * 1e12, 3)"))
def q_metric_regression_bid_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the scale of bids (a few thousandths); the MSE is shown times 1e12."""
    out = regression_metrics(brand_baseline(spark, sf_dir, 1e7), "y", "p", ["l_returnflag"])
    return out.withColumns({"r2": F.round("r2", 9), "mse": F.round(F.col("mse") * 1e12, 3)})


@register("metric_errors", """
    WITH t AS (
        SELECT l_returnflag, l_extendedprice AS y,
               avg(l_extendedprice) OVER (PARTITION BY p_brand) AS p
        FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_returnflag, round(avg(abs(y - p)), 4) AS mae,
        round(CASE WHEN var_pop(y) > 0 THEN 1 - var_pop(y - p) / var_pop(y) END, 9)
            AS explained_variance
    FROM t GROUP BY l_returnflag""")
def q_metric_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error and explained variance of the brand-mean baseline."""
    out = error_metrics(brand_baseline(spark, sf_dir, 1.0), "y", "p", ["l_returnflag"])
    return out.withColumns({"mae": F.round("mae", 4),
                            "explained_variance": F.round("explained_variance", 9)})


@register("metric_median_error", """
    WITH t AS (
        SELECT l_returnflag, l_extendedprice AS y,
               avg(l_extendedprice) OVER (PARTITION BY p_brand) AS p
        FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_returnflag, round(median(abs(y - p)), 4) AS median_absolute_error
    FROM t GROUP BY l_returnflag""")
def q_metric_median_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median absolute error of the brand-mean baseline, by selection."""
    out = median_error(brand_baseline(spark, sf_dir, 1.0), "y", "p", ["l_returnflag"])
    return out.withColumn("median_absolute_error", F.round("median_absolute_error", 4))


SQL_OUTCOMES = """
    SELECT lang, toxic, quality,
           CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(2000.0 AS DOUBLE)) AS s
    FROM labels JOIN documents USING (doc_id)"""


def outcome_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic score per labelled document (longer documents score higher)."""
    n = F.col("n_chars").cast("double")
    return standins.binary_outcomes(spark, sf_dir).select(
        "lang", "toxic", "quality", (n / (n + F.lit(2000.0))).alias("s"))


def _sql_threshold(label: str, group: str, source: str = SQL_OUTCOMES) -> str:
    pred = "(s > 0.5 AND NOT isnan(s))"
    return f"""
    WITH c AS (
        SELECT {group},
            CAST(count(*) FILTER (WHERE {label} = 1 AND {pred}) AS BIGINT) AS tp,
            CAST(count(*) FILTER (WHERE {label} <> 1 AND {pred}) AS BIGINT) AS fp,
            CAST(count(*) FILTER (WHERE {label} = 1 AND NOT {pred}) AS BIGINT) AS fn,
            CAST(count(*) FILTER (WHERE {label} <> 1 AND NOT {pred}) AS BIGINT) AS tn
        FROM ({source}) GROUP BY {group}),
    r AS (SELECT *,
            CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS tpr,
            CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END AS tnr
          FROM c)
    SELECT {group}, tp, fp, fn, tn,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
             ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1,
        CASE WHEN (tpr IS NOT NULL)::INT + (tnr IS NOT NULL)::INT > 0
             THEN (coalesce(tpr, 0.0) + coalesce(tnr, 0.0))
                  / CAST((tpr IS NOT NULL)::INT + (tnr IS NOT NULL)::INT AS DOUBLE) END
             AS balanced_accuracy
    FROM r"""


def _sql_counts(label: str, group_select: str, source: str = SQL_OUTCOMES) -> str:
    return f"""SELECT {group_select}, s,
            CAST(count(*) FILTER (WHERE {label} = 1) AS BIGINT) AS pos,
            CAST(count(*) FILTER (WHERE {label} <> 1) AS BIGINT) AS neg
        FROM ({source}) GROUP BY ALL"""


def _sql_auc(label: str, group: str | None, source: str = SQL_OUTCOMES) -> str:
    g = group or "'all'"
    out = f"g AS {group}, " if group else ""
    return f"""
    WITH c AS ({_sql_counts(label, g + " AS g", source)}),
    r AS (SELECT *, sum(neg) OVER (PARTITION BY g ORDER BY s ASC NULLS FIRST
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM c)
    SELECT {out}
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
            CAST(sum(CAST(pos AS DECIMAL(38,0)) * CAST(2 * neg_cum - neg AS DECIMAL(38,0))) AS DOUBLE)
            / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2.0) END AS auc
    FROM r GROUP BY g"""


def _sql_ap(label: str, group: str, source: str = SQL_OUTCOMES) -> str:
    return f"""
    WITH c AS ({_sql_counts(label, group, source)}),
    r AS (SELECT *,
            sum(pos) OVER (PARTITION BY {group} ORDER BY s DESC NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_cum,
            sum(pos + neg) OVER (PARTITION BY {group} ORDER BY s DESC NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt_cum
          FROM c)
    SELECT {group}, CASE WHEN sum(pos) > 0 THEN round(
            sum(CAST(pos AS DOUBLE) * CAST(pos_cum AS DOUBLE) / CAST(cnt_cum AS DOUBLE))
            / CAST(sum(pos) AS DOUBLE), 9) END AS average_precision
    FROM r GROUP BY {group}"""


@register("metric_threshold", _sql_threshold("toxic", "lang"))
def q_metric_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_metrics(outcome_scores(spark, sf_dir), "toxic", "s", 0.5, ["lang"])


@register("metric_agreement", f"""
    WITH c AS (SELECT lang, toxic = 1 AS y, s > 0.5 AND NOT isnan(s) AS p, s FROM ({SQL_OUTCOMES})),
    k AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (y = p)::DOUBLE AS r,
            count(*) FILTER (p)::DOUBLE * count(*) FILTER (y)
              + count(*) FILTER (NOT p)::DOUBLE * count(*) FILTER (NOT y) AS e,
            avg(-CASE WHEN y THEN ln(s) ELSE ln(1 - s) END) AS l FROM c GROUP BY lang)
    SELECT lang, r / n AS accuracy, CASE WHEN n * n > e THEN (n * r - e) / (n * n - e) END AS kappa,
           round(l, 9) AS log_loss FROM k""")
def q_metric_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, kappa and log-loss of a deterministic score, per language."""
    scored = outcome_scores(spark, sf_dir)
    loss = log_loss(scored, "toxic", "s", ["lang"]).withColumn("log_loss", F.round("log_loss", 9))
    return agreement_metrics(scored, "toxic", "s", 0.5, ["lang"]).join(loss, "lang")


@register("metric_auc", _sql_auc("toxic", "lang"))
def q_metric_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc_auc(outcome_scores(spark, sf_dir), "toxic", "s", ["lang"])


@register("metric_auc_overall", _sql_auc("quality", None))
def q_metric_auc_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc_auc(outcome_scores(spark, sf_dir), "quality", "s")


@register("pr_curve", f"""
    WITH c AS ({_sql_counts("toxic", "lang")}),
    r AS (SELECT lang, s AS score,
            sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS p
          FROM c WINDOW w AS (PARTITION BY lang ORDER BY s DESC NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT lang, score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (tp + fp), 9) AS precision,
           CASE WHEN p > 0 THEN round(tp / p, 9) END AS recall FROM r""")
def q_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at every distinct score, per language."""
    out = pr_curve(outcome_scores(spark, sf_dir), "toxic", "s", ["lang"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@register("metric_average_precision", _sql_ap("toxic", "lang"))
def q_metric_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_precision(outcome_scores(spark, sf_dir), "toxic", "s", ["lang"]).withColumn(
        "average_precision", F.round("average_precision", 9))


# ---------------------------------------------------------------------------------
# Report: J4 F2 A2 R1 R2 on a deterministic conversion score
# ---------------------------------------------------------------------------------
SQL_HOUSEHOLD_VECTORS = f"""
    SELECT l.ehhn, l.event_id, l.LogEntryTime, l.event_type, l.prop_k, l.UserHourOfWeek,
           l.cost, s.ngr_score, s.cohort, m.o_orderkey, m.o_orderdate, m.o_totalprice,
           m.o_orderstatus, m.o_orderpriority
    FROM ({SQL_LATEST}) l
    JOIN ({SQL_SCORES}) s ON l.ehhn = s.ehhn
    JOIN ({SQL_MEDIA_LATEST}) m ON l.ehhn = m.ehhn
    WHERE s.ngr_score IS NOT NULL AND NOT isnan(s.ngr_score)"""
_PRICE_SCALE = 250000.0
SQL_STANDIN_PREDICTIONS = f"""
    SELECT ehhn, cohort,
        o_totalprice / (o_totalprice + CAST({_PRICE_SCALE!r} AS DOUBLE)) AS sales_conversion
    FROM ({SQL_HOUSEHOLD_VECTORS})"""
SQL_SCORED = f"""
    SELECT s.ehhn, s.ngr_score, p.cohort, p.sales_conversion
    FROM ({SQL_SCORES}) s JOIN ({SQL_STANDIN_PREDICTIONS}) p ON s.ehhn = p.ehhn"""


def standin_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic conversion score per household: its latest order value squashed
    into (0, 1). Stands in for model output where an exact oracle is wanted."""
    hv = scoring.household_vectors(spark, sf_dir)
    price = F.col("o_totalprice")
    return hv.select(KEY, "cohort", (price / (price + F.lit(_PRICE_SCALE))).alias(CONVERSION_COLUMN))


@register("cohort_share", f"""
    WITH agg AS (
        SELECT cohort, count(*) AS households,
               count(*) FILTER (WHERE sales_conversion > 0.5 AND NOT isnan(sales_conversion))
                   AS converting
        FROM ({SQL_SCORED}) GROUP BY cohort),
    names AS (SELECT * FROM (VALUES ('BUILDING'), ('FURNITURE'), ('MACHINERY')) v(cohort))
    SELECT n.cohort, CAST(coalesce(households, 0) AS BIGINT) AS households,
           CAST(coalesce(converting, 0) AS BIGINT) AS converting,
           CASE WHEN households > 0 THEN CAST(converting AS DOUBLE) / CAST(households AS DOUBLE)
           END AS share
    FROM names n LEFT JOIN agg ON n.cohort = agg.cohort""")
def q_cohort_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = standin_predictions(spark, sf_dir)
    return conversion_share(preds, standins.campaign_scores(spark, sf_dir), standins.COHORTS)


@register("score_bins", f"""
    WITH j AS (SELECT * FROM ({SQL_SCORED}) WHERE ngr_score IS NOT NULL AND NOT isnan(ngr_score)
               AND sales_conversion IS NOT NULL AND NOT isnan(sales_conversion))
    SELECT cohort,
        CAST(least(floor(sales_conversion * 20), 19) AS INTEGER) AS p_bin,
        CAST(least(floor((ngr_score - (SELECT min(ngr_score) FROM j))
             / ((SELECT max(ngr_score) - min(ngr_score) FROM j) / 20)), 19) AS INTEGER) AS s_bin,
        CAST(count(*) AS BIGINT) AS households
    FROM j GROUP BY ALL""")
def q_score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = standin_predictions(spark, sf_dir)
    return score_bins(preds, standins.campaign_scores(spark, sf_dir))


# ---------------------------------------------------------------------------------
# Models: M1-M3 M5-M9 S6 K5 P14 P15 on realistic labels (no SQL twin: rows-only checks).
# Families at the library's default sizes: 100 trees, boosting up to 10 000 rounds until the
# validation rows say stop.
# ---------------------------------------------------------------------------------
REGRESSORS = {"RF": None, "GBM": None, "LM": {"regParam": [0.0, 0.1]}}
CLASSIFIERS = {"RF": None, "GBM": None, "LR": {"regParam": [0.0, 0.01]}}


@register("train_leaderboard")
def q_train_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest, boosting and two linear models, all rows, default sizes."""
    return training.train_bid_model(spark, sf_dir, REGRESSORS).result.leaderboard


@register("bid_test_metrics")
def q_bid_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion of the default families on the held-out split."""
    return training.train_bid_model(spark, sf_dir).test_metrics


@register("score_bids")
def q_score_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train the default families, save, load the champion, score every audience household
    once."""
    bt = training.train_bid_model(spark, sf_dir)
    path = save_model(bt.result.best, stage_path(spark, "bid-model"))
    model = load_model(path)
    vectors = scoring.household_vectors(spark, sf_dir, bt.encoding)
    return scoring.score_bids(model, vectors)


def _conversion_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, enc = training.prepared_bid_rows(spark, sf_dir)
    result = training.train_conversion_model(prepared, CLASSIFIERS)
    path = save_model(result.best, stage_path(spark, "conversion-model"))
    model = load_model(path)
    return scoring.score_conversion(model, scoring.household_vectors(spark, sf_dir, enc))


@register("score_conversion")
def q_score_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(class 1) by the champion of a forest, boosting and two logistic models, default sizes."""
    return _conversion_predictions(spark, sf_dir)


@register("conversion_test_metrics")
def q_conversion_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion champion scored on the held-out split, per cohort (rows-only)."""
    prepared, _ = training.prepared_bid_rows(spark, sf_dir)
    result = training.train_conversion_model(prepared, CLASSIFIERS)
    return training.conversion_test_metrics(result.best, prepared)


@register("conversion_report")
def q_conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion share per cohort, by the champion of ``score_conversion``."""
    preds = _conversion_predictions(spark, sf_dir)
    return conversion_share(preds, standins.campaign_scores(spark, sf_dir), standins.COHORTS)


@register("live_pricing")
def q_live_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + D2: the impression log replayed as a file stream and priced per impression
    against the weekly household features (rows-only check; ``live_pricing_exact`` has SQL)."""
    bt = training.train_bid_model(spark, sf_dir, {"LM": None})
    return _live(spark, sf_dir, bt.encoding, bt.result.best)


def _live(spark: SparkSession, sf_dir: str, encoding, model) -> DataFrame:
    weekly = stage(scoring.household_vectors(spark, sf_dir, encoding).select(
        KEY, *training.BID_FEATURES), "weekly-features")
    stream = realtime.impression_stream(spark, sf_dir, file_name="events.parquet")
    bids = realtime.live_bids(stream, weekly, encoding, model, watermark="30 days")
    sink = stage_path(spark, "live-bids")
    query = realtime.start_live_pricing(bids, sink, stage_path(spark, "live-bids-checkpoint"))
    query.awaitTermination()
    return spark.read.parquet(sink)


@register("combined_predictions")
def q_combined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bid and conversion predictions of the same households in one table."""
    prepared, enc = training.prepared_bid_rows(spark, sf_dir)
    bid = training.train_bid_model(spark, sf_dir, {"LM": None}, prepared=prepared, encoding=enc)
    conv = training.train_conversion_model(prepared, {"LR": None})
    vectors = scoring.household_vectors(spark, sf_dir, enc)
    return scoring.combined_predictions(bid.result.best, conv.best, vectors)


@register("impute_scores", f"""
    WITH s AS (SELECT ehhn, ngr_score, CASE WHEN ehhn % 5 <> 0 THEN cohort END AS cohort
               FROM ({SQL_ALL_SCORES})),
    m AS (SELECT cohort FROM s WHERE cohort IS NOT NULL GROUP BY cohort
          ORDER BY count(*) DESC, cohort LIMIT 1)
    SELECT ehhn, round(coalesce(ngr_score, (SELECT avg(ngr_score) FROM s)), 6) AS ngr_score,
           coalesce(cohort, (SELECT cohort FROM m)) AS cohort FROM s""")
def q_impute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing campaign scores filled with the mean, missing cohorts (of every fifth
    household here) with the most frequent one."""
    gaps = all_scores(spark, sf_dir).withColumn(
        "cohort", F.when(F.col(KEY) % 5 != 0, F.col("cohort")))
    filled = impute(gaps, numeric=[SCORE], categorical=["cohort"])
    return filled.withColumn(SCORE, F.round(SCORE, 6))


# ---------------------------------------------------------------------------------
# The same model operators where the fit has a closed form, so SQL can say what must come out:
# * bid model: the label is a linear function of the features, which the linear family must
#   find exactly; with an enormous penalty it predicts the training mean;
# * conversion model: one tree of depth 1 on a yes/no feature without bootstrap, so P(class 1)
#   is the weighted share of the row's leaf. The outcome depends on the feature, as a tree
#   whose leaves predict the same class is pruned to its root.
# ---------------------------------------------------------------------------------
EXACT_WEIGHTS = {"event_type": 1e-5, "prop_k": 1e-7, "UserHourOfWeek": 2e-6, "ngr_score": 3e-8,
                 "o_totalprice": 1e-9, "o_orderstatus": 5e-5, "o_orderpriority": 7e-6}
EXACT_BASE = 0.002
EXACT_REGRESSORS = {"LM": {"regParam": [0.0, 1e12]}}
EXACT_CLASSIFIER = {"RF": {"numTrees": [1], "maxDepth": [1], "bootstrap": [False],
                           "featureSubsetStrategy": ["all"]}}
EXACT_FLAG = "early"
_PREPARED = f"({ORACLE_SQL['prepared_training']})"


def _sql_price(prefix: str = "") -> str:
    return " + ".join([f"{EXACT_BASE!r}::DOUBLE"] + [
        f"{w!r}::DOUBLE * {prefix}{c}" for c, w in EXACT_WEIGHTS.items()])


def _exact_bid(spark: SparkSession, sf_dir: str, prepared=None, encoding=None):
    if prepared is None:
        prepared, encoding = training.prepared_bid_rows(spark, sf_dir)
    price = F.lit(EXACT_BASE)
    for c, w in EXACT_WEIGHTS.items():
        price = price + F.lit(w) * F.col(c)
    return training.train_bid_model(spark, sf_dir, EXACT_REGRESSORS,
                                    prepared=prepared.withColumn(LABEL, price), encoding=encoding)


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumn(EXACT_FLAG, (F.col("UserHourOfWeek") < 84).cast("int"))


def _with_outcome(prepared: DataFrame) -> DataFrame:
    """About one in four early rows converts, and three in four of the others."""
    flagged = _flagged(prepared)
    odds = F.when(F.col(EXACT_FLAG) == 1, 1).otherwise(3)
    return flagged.withColumn(training.CONVERSION_LABEL, (
        F.floor("ngr_score") % 4 < odds).cast("int"))


_SQL_OUTCOME = f"""(SELECT * REPLACE ((CAST(floor(ngr_score) AS BIGINT) % 4
    < CASE WHEN UserHourOfWeek < 84 THEN 1 ELSE 3 END)::INT AS converted) FROM {_PREPARED})"""


def _exact_conversion(prepared: DataFrame):
    return training.train_conversion_model(_with_outcome(prepared), EXACT_CLASSIFIER,
                                           feature_cols=[EXACT_FLAG])


# ---------------------------------------------------------------------------------
# Trees on an outcome of three yes/no features, so that SQL can grow the same trees: a node's
# best split is the feature whose sides' sums of squares over counts are largest.
# ---------------------------------------------------------------------------------
STEP_FEATURES = {"early": "UserHourOfWeek < 84", "dear": "o_totalprice > 150000",
                 "scored": "ngr_score > 5000"}
#: In the unit of bids: nothing may hang on the label's size.
STEP_LABEL = "(4 * early + 2 * dear + scored + 0.5 * early * dear + UserHourOfWeek / 100.0) / 1000"
#: Half of MLlib's step: it fits trees to twice the residual, so each round takes a whole step.
BOOSTED_STUMPS = {"GBM": {"maxDepth": [1], "stepSize": [0.5], "validationTol": [0.001]}}
_SQL_FLAGS = ", ".join(f"({c})::INT AS {f}" for f, c in STEP_FEATURES.items())
SQL_STEPS = f"""SELECT *, {STEP_LABEL.replace("100.0", "100.0::DOUBLE")} AS y FROM (
    SELECT split, UserHourOfWeek, {_SQL_FLAGS} FROM {_PREPARED})"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with the yes/no features and the label made of them."""
    prepared, _ = training.prepared_bid_rows(spark, sf_dir)
    flagged = prepared.withColumns(
        {f: F.expr(f"cast({c} as int)") for f, c in STEP_FEATURES.items()})
    return flagged.withColumn(LABEL, F.expr(STEP_LABEL.replace("100.0", "100.0D")))


def _sql_boosting(rounds: int, tol: float) -> str:
    """Boosted stumps over the cells of the three features, round by round: ``f0`` holds the
    model's value in each cell after no round, ``e1`` the validation loss after the first."""
    def sides(cells: str) -> str:
        return " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS side, n, n * (y - v) AS r "
                                  f"FROM {cells}" for f in STEP_FEATURES)

    mine = " ".join(f"WHEN '{f}' THEN {f}" for f in STEP_FEATURES)
    text = f"""WITH rows AS MATERIALIZED (
        SELECT split, early, dear, scored,
               (y - avg(y) FILTER (split = 'train') OVER ())
               / stddev_pop(y) FILTER (split = 'train') OVER () AS y FROM ({SQL_STEPS})),
    held AS MATERIALIZED (SELECT early, dear, scored, count(*) AS n, sum(y) AS y, sum(y * y) AS yy
        FROM rows WHERE split = 'validation' GROUP BY ALL),
    f0 AS MATERIALIZED (SELECT early, dear, scored, count(*) AS n, avg(y) AS y, 0.0::DOUBLE AS v
        FROM rows WHERE split = 'train' GROUP BY ALL)"""
    for k in range(rounds):
        text += f""",
    s{k} AS MATERIALIZED (SELECT f, side, sum(r) / sum(n) AS mean, sum(r) * sum(r) / sum(n) AS g
        FROM ({sides(f"f{k}")}) GROUP BY f, side),
    b{k} AS MATERIALIZED (SELECT f FROM s{k} GROUP BY f ORDER BY sum(g) DESC LIMIT 1),
    f{k + 1} AS MATERIALIZED (SELECT c.early, c.dear, c.scored, c.n, c.y, c.v + s{k}.mean AS v
        FROM f{k} c, b{k} JOIN s{k} USING (f) WHERE s{k}.side = CASE b{k}.f {mine} END),
    e{k + 1} AS MATERIALIZED (SELECT {k + 1} AS k,
        sum(h.yy - 2 * c.v * h.y + c.v * c.v * h.n) / sum(h.n) AS e
        FROM held h JOIN f{k + 1} c USING (early, dear, scored))"""
    losses = " UNION ALL ".join(f"SELECT * FROM e{k + 1}" for k in range(rounds))
    return text + f""",
    e AS (SELECT k, e, lag(e) OVER (ORDER BY k) AS before FROM ({losses})),
    best AS (SELECT coalesce(min(k) FILTER (
        before - e < {tol}::DOUBLE * greatest(e, 0.01::DOUBLE)), {rounds + 1}) - 1 AS k FROM e)
    SELECT 'GBM' AS family, CAST(k AS INTEGER) AS rounds,
           round(1 - e / (SELECT var_pop(y) FROM rows WHERE split = 'validation'), 6) AS score
    FROM best JOIN e USING (k)"""


@register("gbm_early_stop_exact", _sql_boosting(20, BOOSTED_STUMPS["GBM"]["validationTol"][0]))
def q_gbm_early_stop_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 M3: boosted stumps with the default limit of 10 000 rounds; the rounds kept and their
    validation R^2. SQL grows the same stumps (20 rounds of them; far fewer are kept)."""
    result = training.train_bid_model(spark, sf_dir, BOOSTED_STUMPS, prepared=_steps(spark, sf_dir),
                                      feature_cols=tuple(STEP_FEATURES)).result
    return result.rounds.join(result.leaderboard, ["family", "params"]).select(
        "family", "rounds", F.round("score", 6).alias("score"))


def _sql_depth_two() -> str:
    """A regression tree of depth 2 over the cells of the three features."""
    names = list(STEP_FEATURES)

    def side(of: str, table: str = "") -> str:
        return f"CASE {of} " + " ".join(f"WHEN '{f}' THEN {table}{f}" for f in names) + " END"

    roots = " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS side, n, s FROM c" for f in names)
    below = " UNION ALL ".join(f"SELECT {side('b.f')} AS top, '{f}' AS f, {f} AS side, n, s "
                               f"FROM c, b WHERE b.f <> '{f}'" for f in names)
    return f"""WITH rows AS MATERIALIZED ({SQL_STEPS}),
    c AS MATERIALIZED (SELECT early, dear, scored, count(*) AS n, sum(y) AS s FROM rows
        WHERE split = 'train' GROUP BY ALL),
    b AS MATERIALIZED (SELECT f FROM (SELECT f, side, sum(s) * sum(s) / sum(n) AS g
        FROM ({roots}) GROUP BY f, side) GROUP BY f ORDER BY sum(g) DESC LIMIT 1),
    d AS MATERIALIZED (SELECT top, f, side, sum(s) / sum(n) AS p, sum(s) * sum(s) / sum(n) AS g
        FROM ({below}) GROUP BY top, f, side),
    w AS MATERIALIZED (SELECT top, f FROM d GROUP BY top, f
        QUALIFY row_number() OVER (PARTITION BY top ORDER BY sum(g) DESC) = 1)
    SELECT t.split, t.early, t.dear, t.scored, count(*) AS n,
           round(any_value(d.p) * 1000, 9) AS bid
    FROM rows t, b, w JOIN d USING (top, f)
    WHERE w.top = {side("b.f", "t.")} AND d.side = {side("w.f", "t.")}
    GROUP BY ALL"""


@register("rf_regressor_exact", _sql_depth_two())
def q_rf_regressor_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: a forest of three trees of depth 2 without bootstrap or feature sampling, so all are
    the tree that SQL grows; its predictions (times 1000) by cell and split."""
    rows = _steps(spark, sf_dir)
    grid = {"RF": {"numTrees": [3], "maxDepth": [2], "bootstrap": [False],
                   "featureSubsetStrategy": ["all"]}}
    best = training.train_bid_model(spark, sf_dir, grid, prepared=rows,
                                    feature_cols=tuple(STEP_FEATURES)).result.best
    return best.transform(rows).groupBy(SPLIT, *STEP_FEATURES).agg(
        F.count("*").alias("n"), F.round(F.first(PREDICTION) * 1000, 9).alias("bid"))


# An ensemble of three one-split trees, one for each yes/no feature: SQL knows their predictions (the
# training means by feature), and selects greedily as the library does.
def _sql_ensemble(additions: int) -> str:
    names = list(STEP_FEATURES)
    k = range(len(names))
    pairs = [(i, j) for i in k for j in k]

    def error(counts: list[str], n: int) -> str:
        return "(" + " + ".join(f"({counts[i]}) * ({counts[j]}) * e{i}{j}" for i, j in pairs) + \
            f") / {n * n}.0::DOUBLE"

    text = f"""WITH rows AS MATERIALIZED ({SQL_STEPS}),
    p AS (SELECT split, y, {", ".join(
        f"avg(y) FILTER (split = 'train') OVER (PARTITION BY {f}) - y AS d{i}"
        for i, f in enumerate(names))} FROM rows),
    e AS MATERIALIZED (SELECT {", ".join(f"sum(d{i} * d{j}) AS e{i}{j}" for i, j in pairs)},
        var_pop(y) * count(*) AS sst FROM p WHERE split = 'validation'),
    g0 AS (SELECT {", ".join(f"0 AS c{i}" for i in k)})"""
    for n in range(1, additions + 1):
        options = [error([f"c{i} + 1" if i == j else f"c{i}" for i in k], n) for j in k]
        text += f""",
    o{n} AS MATERIALIZED (SELECT c0, c1, c2, least({", ".join(options)}) AS best,
        {", ".join(f"{o} AS a{j}" for j, o in enumerate(options))} FROM g{n - 1}, e),
    g{n} AS MATERIALIZED (SELECT {n} AS n, best, {", ".join(
        f"c{i} + (a{i} = best {' '.join(f'AND a{j} <> best' for j in range(i))})::INT AS c{i}"
        for i in k)} FROM o{n})"""
    steps = " UNION ALL ".join(f"SELECT * FROM g{n}" for n in range(1, additions + 1))
    return text + f""",
    w AS (SELECT * FROM ({steps}) ORDER BY best, n LIMIT 1)
    """ + " UNION ALL ".join(
        f"SELECT '{f}' AS member, round(c{i} / n, 6) AS weight, round(1 - e{i}{i} / sst, 6) AS r2, "
        f"round(1 - best / sst, 6) AS ensemble_r2 FROM w, e" for i, f in enumerate(names))


ENSEMBLE_ADDITIONS = 8


@register("ensemble_exact", _sql_ensemble(ENSEMBLE_ADDITIONS))
def q_ensemble_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: weights of three members from one aggregate of the products of their errors."""
    rows = stage(_steps(spark, sf_dir), "steps")
    stump = {"RF": {"numTrees": [1], "maxDepth": [1], "bootstrap": [False],
                    "featureSubsetStrategy": ["all"]}}
    models = [training.train_bid_model(spark, sf_dir, stump, prepared=rows, feature_cols=(f,)
                                       ).result.best for f in STEP_FEATURES]
    _, report = fit_ensemble(models, rows.where(F.col(SPLIT) == VALIDATION), LABEL,
                             ENSEMBLE_ADDITIONS)
    names = F.array(*[F.lit(f) for f in STEP_FEATURES])
    return report.select(F.element_at(names, F.col("member") + 1).alias("member"), *[
        F.round(c, 6).alias(c) for c in ("weight", "r2", "ensemble_r2")])


# Households as the scorers see them: latest impression and order, encoded like the training rows.
_VECTOR_COLUMNS = ["ehhn", "cohort", "event_type", "prop_k", "UserHourOfWeek", "ngr_score",
                   "o_totalprice", "o_orderstatus", "o_orderpriority"]


def _sql_encoded(rows: str, columns: list[str], categoricals: list[str]) -> str:
    return sql_ordinal_transform(rows, columns, categoricals, sql_ordinal_mapping(
        SQL_BID_ROWS, training.BID_CATEGORICALS, "ImpressionId"))


SQL_VECTORS = _sql_encoded(SQL_HOUSEHOLD_VECTORS, _VECTOR_COLUMNS, training.BID_CATEGORICALS)
SQL_LEAVES = f"""
    SELECT (UserHourOfWeek < 84)::INT AS early,
           sum(CASE WHEN converted = 1 THEN w1 ELSE 0 END)
             / sum(CASE WHEN converted = 1 THEN w1 ELSE w0 END) AS p
    FROM {_SQL_OUTCOME}, (SELECT count(*) / (2.0::DOUBLE * sum(converted)) AS w1,
        count(*) / (2.0::DOUBLE * sum(1 - converted)) AS w0 FROM {_SQL_OUTCOME})
    WHERE split = 'train' GROUP BY 1"""
SQL_EXACT_CONVERSION = f"""
    SELECT v.ehhn, v.cohort, CAST(1 AS INTEGER) AS week, round(l.p, 9) AS sales_conversion
    FROM ({SQL_VECTORS}) v JOIN ({SQL_LEAVES}) l ON l.early = (v.UserHourOfWeek < 84)::INT"""
SQL_EXACT_BIDS = f"SELECT ehhn, CAST(1 AS INTEGER) AS week, round({_sql_price()}, 9) AS basebid " \
                 f"FROM ({SQL_VECTORS})"


@register("train_leaderboard_exact", f"""
    WITH t AS (SELECT split, {_sql_price()} AS y FROM {_PREPARED}),
    m AS (SELECT avg(y) AS m FROM t WHERE split = 'train')
    SELECT 'LM' AS family, '{{"regParam": 0.0}}' AS params, 'r2' AS metric,
           1.0::DOUBLE AS score, true AS is_champion
    UNION ALL
    SELECT 'LM', '{{"regParam": 1000000000000.0}}', 'r2',
           round(1 - sum((y - m) * (y - m)) / (var_pop(y) * count(y)), 6), false
    FROM t, m WHERE split = 'validation'""")
def q_train_leaderboard_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 M2 M3: two points of a grid; the exact one wins with R^2 = 1."""
    board = _exact_bid(spark, sf_dir).result.leaderboard
    return board.withColumn("score", F.round("score", 6))


@register("bid_test_metrics_exact", f"""
    SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_missing, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS mse
    FROM {_PREPARED} WHERE split = 'test'""")
def q_bid_test_metrics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the champion on the held-out split; the MSE is shown times 1e12."""
    out = _exact_bid(spark, sf_dir).test_metrics
    return out.withColumns({"r2": F.round("r2", 6), "mse": F.round(F.col("mse") * 1e12, 6)})


@register("score_bids_exact", SQL_EXACT_BIDS)
def q_score_bids_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, save, load, score every audience household."""
    bt = _exact_bid(spark, sf_dir)
    model = load_model(save_model(bt.result.best, stage_path(spark, "bid-model")))
    bids = scoring.score_bids(model, scoring.household_vectors(spark, sf_dir, bt.encoding))
    return bids.withColumn("basebid", F.round("basebid", 9))


def _exact_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, enc = training.prepared_bid_rows(spark, sf_dir)
    model = load_model(save_model(_exact_conversion(prepared).best,
                                  stage_path(spark, "conversion-model")))
    vectors = _flagged(scoring.household_vectors(spark, sf_dir, enc))
    return scoring.score_conversion(model, vectors)


@register("score_conversion_exact", SQL_EXACT_CONVERSION)
def q_score_conversion_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all cohorts in one pass."""
    return _exact_conversions(spark, sf_dir).withColumn(
        CONVERSION_COLUMN, F.round(CONVERSION_COLUMN, 9))


@register("score_from_csv", SQL_EXACT_CONVERSION)
def q_score_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 S4 into M6: vectors written as CSV per cohort, read back and scored."""
    prepared, enc = training.prepared_bid_rows(spark, sf_dir)
    model = _exact_conversion(prepared).best
    vectors = _flagged(scoring.household_vectors(spark, sf_dir, enc)).select(
        KEY, EXACT_FLAG, "cohort")
    root = write_csv(vectors, stage_path(spark, "vectors-csv"), partition_by=["cohort"])
    back = read_cohorts(spark, {c: f"{root}/cohort={c}" for c in standins.COHORTS},
                        f"{KEY} bigint, {EXACT_FLAG} int")
    return scoring.score_conversion(model, back).withColumn(
        CONVERSION_COLUMN, F.round(CONVERSION_COLUMN, 9))


@register("conversion_report_exact", f"""
    WITH j AS (SELECT p.cohort, p.sales_conversion FROM ({SQL_EXACT_CONVERSION}) p
               JOIN ({SQL_SCORES}) s ON p.ehhn = s.ehhn),
    names AS (SELECT * FROM (VALUES ('BUILDING'), ('FURNITURE'), ('MACHINERY')) v(cohort))
    SELECT n.cohort, count(j.cohort) AS households,
           count(*) FILTER (WHERE sales_conversion > 0.5) AS converting,
           CASE WHEN count(j.cohort) > 0 THEN CAST(count(*) FILTER (WHERE sales_conversion > 0.5)
                AS DOUBLE) / CAST(count(j.cohort) AS DOUBLE) END AS share
    FROM names n LEFT JOIN j ON n.cohort = j.cohort GROUP BY n.cohort""")
def q_conversion_report_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion_share(_exact_conversions(spark, sf_dir),
                            standins.campaign_scores(spark, sf_dir), standins.COHORTS)


_SQL_TEST_SCORES = f"""SELECT t.cohort, t.converted, l.p AS s FROM {_SQL_OUTCOME} t
    JOIN ({SQL_LEAVES}) l ON l.early = (t.UserHourOfWeek < 84)::INT WHERE t.split = 'test'"""


@register("conversion_test_metrics_exact", f"""
    SELECT t.*, round(a.auc, 9) AS auc, p.average_precision
    FROM ({_sql_threshold("converted", "cohort", _SQL_TEST_SCORES)}) t
    JOIN ({_sql_auc("converted", "cohort", _SQL_TEST_SCORES)}) a USING (cohort)
    JOIN ({_sql_ap("converted", "cohort", _SQL_TEST_SCORES)}) p USING (cohort)""")
def q_conversion_test_metrics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, _ = training.prepared_bid_rows(spark, sf_dir)
    out = training.conversion_test_metrics(_exact_conversion(prepared).best, _with_outcome(prepared))
    return out.withColumns({c: F.round(c, 9) for c in ("auc", "average_precision")})


@register("combined_predictions_exact", f"""
    SELECT b.ehhn, c.cohort, b.week, b.basebid, c.sales_conversion
    FROM ({SQL_EXACT_BIDS}) b JOIN ({SQL_EXACT_CONVERSION}) c USING (ehhn)""")
def q_combined_predictions_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models over the same rows in one pass."""
    prepared, enc = training.prepared_bid_rows(spark, sf_dir)
    bid = _exact_bid(spark, sf_dir, prepared, enc).result.best
    vectors = _flagged(scoring.household_vectors(spark, sf_dir, enc))
    out = scoring.combined_predictions(bid, _exact_conversion(prepared).best, vectors)
    return out.withColumns({c: F.round(c, 9) for c in ("basebid", CONVERSION_COLUMN)})


_SQL_LIVE_ROWS = f"""
    SELECT lg.event_id, lg.ehhn, lg.LogEntryTime, lg.event_type, lg.prop_k, lg.UserHourOfWeek,
           w.ngr_score, w.o_totalprice, w.o_orderstatus, w.o_orderpriority,
           w.ehhn IS NOT NULL AS weekly
    FROM ({SQL_LOG}) lg LEFT JOIN ({SQL_VECTORS}) w ON lg.ehhn = w.ehhn"""


@register("live_pricing_exact", f"""
    SELECT ehhn, event_id, LogEntryTime AS event_ts,
           CASE WHEN weekly THEN round({_sql_price()}, 9) END AS basebid,
           CASE WHEN NOT weekly THEN 'no weekly features' END AS reason
    FROM ({_sql_encoded(_SQL_LIVE_ROWS, ["event_id", "ehhn", "LogEntryTime", "event_type", "prop_k",
                                         "UserHourOfWeek", "ngr_score", "o_totalprice",
                                         "o_orderstatus", "o_orderpriority", "weekly"],
                        ["event_type", "prop_k"])})""")
def q_live_pricing_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + D2: one row per impression of the whole log, with a bid or the reason why not."""
    bt = _exact_bid(spark, sf_dir)
    live = _live(spark, sf_dir, bt.encoding, bt.result.best)
    return live.withColumns({"basebid": F.round("basebid", 9),
                             "event_ts": F.col("event_ts").cast("timestamp_ntz")})


# The log as it is delivered: in periods of 12 days, one in seven events a period late, one in ten
# delivered again a period later, one in thirty twice at once. Four days' delay is allowed.
_ARRIVAL = "CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 1036800) AS INT)"
LIVE_DELAY = "4 days"
SQL_DELIVERIES = f"""
    SELECT event_id, ts, {_ARRIVAL} + (event_id % 7 = 3)::INT AS a FROM events
    UNION ALL SELECT event_id, ts, {_ARRIVAL} + (event_id % 7 = 3)::INT + 1 FROM events
    WHERE event_id % 10 = 0
    UNION ALL SELECT event_id, ts, {_ARRIVAL} + (event_id % 7 = 3)::INT FROM events
    WHERE event_id % 30 = 0"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of their delivery's period."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = F.floor(F.timestamp_diff(
        "SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1036800
    ) + (F.col("event_id") % 7 == 3).cast("int")
    times = F.when(F.col("event_id") % 30 == 0, F.array(first, first + 1, first)).when(
        F.col("event_id") % 10 == 0, F.array(first, first + 1)).otherwise(F.array(first))
    return events.withColumn("arrival", F.explode(times.cast("array<int>")))


@register("live_pricing_admitted", f"""
    WITH d AS ({SQL_DELIVERIES}),
    m AS (SELECT a, max(ts) AS m FROM d GROUP BY a),
    j AS (SELECT d.event_id, d.ts, d.a, d.ts <= max(m.m) - INTERVAL {LIVE_DELAY} AS late
          FROM (SELECT row_number() OVER () AS k, * FROM d) d LEFT JOIN m ON m.a < d.a
          GROUP BY d.k, d.event_id, d.ts, d.a),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id, coalesce(late, false)
                                       ORDER BY a) AS turn FROM j)
    SELECT p.ehhn, p.event_id, p.event_ts,
           CASE WHEN NOT coalesce(late, false) AND turn = 1 THEN p.basebid END AS basebid,
           CASE WHEN coalesce(late, false) THEN 'late' WHEN turn > 1 THEN 'repeated'
                ELSE p.reason END AS reason
    FROM r JOIN ({ORACLE_SQL["live_pricing_exact"]}) p USING (event_id)""")
def q_live_pricing_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + D2: every delivery of the log once, priced, repeated, without weekly features or late.
    Admission and pricing are stopped and begun again as the periods arrive."""
    bt = _exact_bid(spark, sf_dir)
    weekly = stage(scoring.household_vectors(spark, sf_dir, bt.encoding).select(
        KEY, *training.BID_FEATURES), "weekly-features")
    source, root, sink = (stage_path(spark, f"live-{x}") for x in ("source", "admitted", "priced"))
    checkpoints = [stage_path(spark, f"live-{x}-checkpoint") for x in ("admission", "pricing")]
    events = stage(deliveries(spark, sf_dir), "deliveries")
    arrivals = [r["arrival"] for r in events.select("arrival").distinct().orderBy(
        "arrival").collect()]
    for arrival in arrivals:
        write_parquet(events.where(F.col("arrival") == arrival).drop("arrival"), source,
                      mode="append")
        stream = realtime.impression_stream(spark, source)
        admission.start_admission(stream, root, checkpoints[0], LIVE_DELAY).awaitTermination()
        if arrival in (arrivals[0], arrivals[-1]):
            accepted = admission.accepted_stream(spark, root, stream.schema)
            bids = stateful.live_bids_stateful(accepted, weekly, bt.encoding, bt.result.best,
                                               LIVE_DELAY)
            realtime.start_live_pricing(bids, sink, checkpoints[1]).awaitTermination()
    late = admission.late_impressions(spark, root, stream.schema).select(
        KEY, "event_id", realtime.EVENT_TS, F.lit(None).cast("double").alias(BID_COLUMN),
        F.lit("late").alias("reason"))
    every = spark.read.parquet(sink).unionByName(late)
    return every.withColumns({BID_COLUMN: F.round(BID_COLUMN, 9),
                              realtime.EVENT_TS: F.col(realtime.EVENT_TS).cast("timestamp_ntz")})


# ---------------------------------------------------------------------------------
# Sources and sinks: S2 S3 S4 S5 K1 K2 K3 (+ latest partition)
# ---------------------------------------------------------------------------------
SQL_SNAPSHOT_TREE = """
    SELECT o_custkey AS ehhn, o_orderkey, o_orderdate, o_totalprice, o_orderpriority,
           o_orderstatus AS channel_type, CAST(date_trunc('month', o_orderdate) AS DATE) AS cycle_date
    FROM orders"""
_SNAPSHOT_CHANNEL, _SNAPSHOT_DATE = "F", "1998-06-01"


def write_snapshot_tree(spark: SparkSession, sf_dir: str) -> str:
    """The orders table as a ``channel_type=/cycle_date=`` tree under the staging folder."""
    orders = standins.table(spark, sf_dir, "orders")
    tree = orders.select(
        F.col("o_custkey").alias(KEY), "o_orderkey", "o_orderdate", "o_totalprice",
        "o_orderpriority", F.col("o_orderstatus").alias("channel_type"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("cycle_date"))
    path = stage_path(spark, "snapshot-tree")
    # dealt by leaf first: each leaf's files don't multiply with the tasks
    write_parquet(tree.repartition("channel_type", "cycle_date"), path,
                  partition_by=["channel_type", "cycle_date"])
    return path


@register("partition_scan", f"""
    SELECT * FROM ({SQL_SNAPSHOT_TREE})
    WHERE channel_type = '{_SNAPSHOT_CHANNEL}' AND cycle_date = DATE '{_SNAPSHOT_DATE}'""")
def q_partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = write_snapshot_tree(spark, sf_dir)
    return read_partition(spark, root, channel_type=_SNAPSHOT_CHANNEL, cycle_date=_SNAPSHOT_DATE)


@register("latest_partition", f"""
    SELECT * FROM ({SQL_SNAPSHOT_TREE}) WHERE channel_type = '{_SNAPSHOT_CHANNEL}'
      AND cycle_date = (SELECT max(cycle_date) FROM ({SQL_SNAPSHOT_TREE})
                        WHERE channel_type = '{_SNAPSHOT_CHANNEL}')""")
def q_latest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = write_snapshot_tree(spark, sf_dir)
    return latest_partition(spark, root, "cycle_date", channel_type=_SNAPSHOT_CHANNEL)


SCORE_SCHEMA = "ehhn bigint, ngr_score double"


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("csv_round_trip", SQL_ALL_SCORES)
def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as CSV per cohort directory, read back as one frame by cohort."""
    root = write_csv(all_scores(spark, sf_dir), stage_path(spark, "scores-csv"),
                     partition_by=["cohort"])
    paths = {c: f"{root}/cohort={c}" for c in SEGMENTS}
    return read_cohorts(spark, paths, SCORE_SCHEMA)


@register("weekly_csv", f"""
    SELECT ehhn, ngr_score, cohort, CAST(3 AS INTEGER) AS week,
           strftime(TIMESTAMP '2024-01-01 07:00:00' + INTERVAL 1 HOUR * (ehhn % 50), '%m%d%Y%H')
               AS stamp FROM ({SQL_ALL_SCORES})""")
def q_weekly_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + K4: scores with a run stamp, written as CSV by cohort and week, read back."""
    at = F.expr(f"timestamp_ntz'2024-01-01 07:00:00' + make_dt_interval(0, int({KEY} % 50))")
    rows = all_scores(spark, sf_dir).withColumn("week", F.lit(3)).withColumn(
        "stamp", run_stamp_column(at))
    root = scoring.write_scores(rows, stage_path(spark, "weekly-csv"))
    back = read_csv(spark, root, f"{SCORE_SCHEMA}, stamp string")
    return back.select(KEY, SCORE, F.col("cohort").cast("string").alias("cohort"),
                       F.col("week").cast("int").alias("week"), "stamp")


@register("staged_reread", SQL_LATEST_ALL)
def q_staged_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(q_latest_per_key(spark, sf_dir), "latest-impressions")
