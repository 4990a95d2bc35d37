"""Feature extraction: impression logs -> per-household inference vectors.

Steps (one lazy plan from scan to encoded output; nothing is collected):
1. union the yearly logs by name and project the used columns (U1, P1);
2. restrict to the campaign audience with a left semi join on the household key (J1);
   the key list is broadcast only when its bytes are below the broadcast bound;
3. keep each household's latest impression (W1, W2; tie-break on ``event_id``);
4. join the campaign score (J2) and the media-engagement snapshot (J3);
5. drop rows with any null (F3);
6. ordinal-encode the categorical columns (E1, E2).

Restricting with a semi join on the score keys gives the same rows as an inner join with
``intersect(log keys, score keys)``: the intersect is kept as its own output
(``audience``) for the audience file, not recomputed inside the feature plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..constants import (
    CATEGORICAL_FEATURES,
    EVENT_TIME,
    IMPRESSION_COLUMNS,
    KEY,
    SCORE,
    SOURCE_KEY,
    SOURCE_SCORE,
)
from ..operators.encoding import OrdinalEncoding, ordinal_fit
from ..operators.latest import latest_within_keys
from ..operators.relational import (
    audience,
    drop_incomplete,
    join_on_key,
    rename_columns,
    union_logs,
)
from ..sources import standins
from ..sources.files import stage

# --- fixed values -------------------------------------------------------------
LOG_COLUMNS = ["event_id", KEY, EVENT_TIME, "event_type", "prop_k", "UserHourOfWeek", "cost"]
FEATURE_CATEGORICALS = ["event_type", "prop_k", "o_orderstatus", "o_orderpriority"]
# One feature row per (household, snapshot order): o_orderkey orders the rows for the
# first-appearance encoding.
FEATURE_ORDER_KEY = "o_orderkey"
# --- end of fixed values -------------------------------------------------------


# ---------------------------------------------------------------------------------
# Generic plan: DataFrames in, DataFrame out, reference column names as defaults.
# ---------------------------------------------------------------------------------
def keyed_source(df: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """A campaign-side table keyed ``HSHD_CODE`` renamed to ``ehhn`` (plus ``extra``
    renames, e.g. ``{"campaign_score": "ngr_score"}``); a missing name fails."""
    return rename_columns(df, {SOURCE_KEY: KEY, **(extra or {})})


def campaign_scores_from_source(df: DataFrame) -> DataFrame:
    """The campaign score table as delivered: ``HSHD_CODE``, ``campaign_score``, ..."""
    return keyed_source(df, {SOURCE_SCORE: SCORE})


def latest_in_audience(logs: Sequence[DataFrame], scores: DataFrame,
                       log_columns: Sequence[str] | None = IMPRESSION_COLUMNS,
                       tie_breaker: str | Sequence[str] | None = None,
                       max_broadcast_bytes: int | None = None) -> DataFrame:
    """Steps 1-3 on any yearly logs and score table keyed ``ehhn``."""
    log = union_logs(list(logs), log_columns)
    return latest_within_keys(log, scores, KEY, EVENT_TIME, tie_breaker, max_broadcast_bytes)


def complete_rows(latest: DataFrame, scores: DataFrame, media: DataFrame,
                  score_columns: Sequence[str] | None = None,
                  on_media_duplicate: str = "keep",
                  media_order: Sequence[str] | None = None,
                  media_tie_breaker: str | None = None) -> DataFrame:
    """Steps 4-5: join the score and the media snapshot on ``ehhn``, keep complete rows.
    ``on_media_duplicate`` is the fan-out policy for repeated keys in the snapshot; for
    ``latest`` the snapshot rows are ordered by ``media_order``, then ``media_tie_breaker``."""
    cols = list(score_columns) if score_columns else scores.columns
    with_score = join_on_key(latest, scores.select(*cols))
    with_media = join_on_key(with_score, media, on_duplicate=on_media_duplicate,
                             order_by=media_order, tie_breaker=media_tie_breaker)
    return drop_incomplete(with_media)


def encode_rows(rows: DataFrame, categoricals: Sequence[str], order_key: str | Sequence[str],
                encoding: OrdinalEncoding | None = None) -> DataFrame:
    """Step 6: with no ``encoding`` one is fitted on ``rows`` (staged first, so the fit and
    the transform share one computation of the rows) in ``order_key`` order."""
    if encoding is None:
        rows = stage(rows, "feature-rows")
        encoding = ordinal_fit(rows, list(categoricals), order_key)
    return encoding.transform(rows)


def feature_vectors_from(logs: Sequence[DataFrame], scores: DataFrame, media: DataFrame,
                         categoricals: Sequence[str] = CATEGORICAL_FEATURES,
                         order_key: str | Sequence[str] = (EVENT_TIME, KEY),
                         log_columns: Sequence[str] | None = IMPRESSION_COLUMNS,
                         tie_breaker: str | Sequence[str] | None = None,
                         score_columns: Sequence[str] | None = None,
                         encoding: OrdinalEncoding | None = None) -> DataFrame:
    """Steps 1-6 for callers holding their own tables with the reference's column names:
    yearly impression logs (``IMPRESSION_COLUMNS``), a score table keyed ``ehhn`` (see
    ``campaign_scores_from_source``) and a media-engagement snapshot keyed ``ehhn``."""
    latest = latest_in_audience(logs, scores, log_columns, tie_breaker)
    rows = complete_rows(latest, scores, media, score_columns)
    return encode_rows(rows, categoricals, order_key, encoding)


# ---------------------------------------------------------------------------------
# The same plan over the driver's stand-in tables.
# ---------------------------------------------------------------------------------
def impression_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    older, newer = standins.impression_logs(spark, sf_dir)
    return union_logs([older, newer], LOG_COLUMNS)


def audience_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households in both the impression log and the campaign score (the audience file)."""
    return audience(impression_log(spark, sf_dir), standins.campaign_scores(spark, sf_dir))


def latest_impressions(spark: SparkSession, sf_dir: str,
                       max_broadcast_bytes: int | None = None) -> DataFrame:
    """Steps 2-3: each audience household's latest impression."""
    return latest_in_audience(standins.impression_logs(spark, sf_dir),
                              standins.campaign_scores(spark, sf_dir), LOG_COLUMNS,
                              "event_id", max_broadcast_bytes)


def raw_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps 1-5: complete, un-encoded feature rows."""
    return complete_rows(latest_impressions(spark, sf_dir),
                         standins.campaign_scores(spark, sf_dir),
                         standins.media_engagement(spark, sf_dir), [KEY, SCORE, "cohort"])


def feature_vectors(spark: SparkSession, sf_dir: str,
                    encoding: OrdinalEncoding | None = None) -> DataFrame:
    """Steps 1-6 on the stand-in tables."""
    return encode_rows(raw_feature_vectors(spark, sf_dir), FEATURE_CATEGORICALS,
                       FEATURE_ORDER_KEY, encoding)
