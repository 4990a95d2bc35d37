"""Real-time household pricing with Structured Streaming.

Our reading of the real-time phase the workflow describes in prose only (there is no
code for it): every incoming impression is priced for its household.

* source: a file stream of impression logs (parquet), read with an explicit schema;
* late and repeated events: event-time watermark, then ``dropDuplicatesWithinWatermark``
  on the impression id (the watermark needs a ``timestamp``, so ``timestamp_ntz`` is
  cast first). The caller names the watermark: impressions that come later than that are
  not priced, and ``late_rows`` counts them;
* live categoricals are encoded with the training mapping (stream-static joins on the
  small, broadcast mapping);
* features: live values first, the weekly household features as fallback (D2:
  ``coalesce(live, weekly)``). It is a left join: an impression of a household without
  weekly features comes out too, with a null bid and the reason;
* the model is applied per micro-batch on the executors; the parquet sink with a
  checkpoint gives exactly-once output across restarts and lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import BID_COLUMN, KEY
from ..models.score import check_features
from ..models.train import PREDICTION
from ..operators.broadcast import maybe_broadcast
from ..operators.encoding import OrdinalEncoding

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")
EVENT_TS = "event_ts"
HAS_WEEKLY = "_has_weekly"
NO_WEEKLY = "no weekly features"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def impression_stream(spark: SparkSession, path: str, file_name: str | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming impressions with the batch column names (key ``ehhn``)."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if file_name:
        reader = reader.option("pathGlobFilter", file_name)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(path)
    return raw.select(
        F.col("event_id"),
        F.col("user_id").alias(KEY),
        F.col("ts").cast("timestamp").alias(EVENT_TS),
        F.col("event_type"),
        F.get_json_object("props", "$.k").alias("prop_k"),
        ((F.dayofweek("ts") - 1) * 24 + F.hour("ts")).alias("UserHourOfWeek"),
        F.col("value").alias("cost"),
    )


def deduplicated(impressions: DataFrame, watermark: str) -> DataFrame:
    """Drop repeated deliveries of the same impression that arrive within the watermark
    (and impressions that come later than it; see ``late_rows``)."""
    return (impressions.withWatermark(EVENT_TS, watermark)
            .dropDuplicatesWithinWatermark(["event_id"]))


def live_features(impressions: DataFrame, weekly: DataFrame, encoding: OrdinalEncoding,
                  live_columns: Sequence[str]) -> DataFrame:
    """Encode the live categoricals and attach the weekly household features. For the
    ``live_columns`` present on both sides the live value wins and the weekly value fills
    its nulls; any other shared column keeps its live value."""
    to_encode = [c for c in encoding.columns if c in impressions.columns]
    encoded = encoding.transform(impressions, columns=to_encode)
    weekly_cols = [c for c in weekly.columns if c != KEY]
    w = weekly.select(KEY, F.lit(True).alias(HAS_WEEKLY),
                      *[F.col(c).alias(f"_w_{c}") for c in weekly_cols])
    # The weekly side is static: broadcast it when its row count allows, so a micro-batch
    # never shuffles it; otherwise every batch shuffle-joins it on the key.
    w, _ = maybe_broadcast(w)
    joined = encoded.join(w, KEY, "left")
    out = [F.col(HAS_WEEKLY)]
    for c in encoded.columns:
        if c in weekly_cols and c in live_columns:
            out.append(F.coalesce(F.col(c), F.col(f"_w_{c}")).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"_w_{c}").alias(c) for c in weekly_cols if c not in encoded.columns]
    return joined.select(*out)


def live_bids(impressions: DataFrame, weekly: DataFrame, encoding: OrdinalEncoding,
              model: PipelineModel, watermark: str,
              live_columns: Sequence[str] = ("event_type", "prop_k", "UserHourOfWeek")
              ) -> DataFrame:
    """``(ehhn, event_id, event_ts, basebid, reason)``: one row per impression; ``reason``
    is null for a priced one. ``weekly`` is read by every micro-batch, so pass a written
    table (one row per household), not a plan."""
    feats = live_features(deduplicated(impressions, watermark), weekly, encoding, live_columns)
    check_features(feats, model)
    priced = F.col(HAS_WEEKLY).isNotNull()
    return model.transform(feats).select(
        KEY, "event_id", EVENT_TS, F.when(priced, F.col(PREDICTION)).alias(BID_COLUMN),
        F.when(~priced, NO_WEEKLY).alias("reason"))


def late_rows(query: StreamingQuery) -> int:
    """Impressions that came later than the watermark, over the progress reports kept."""
    return sum(int(op["numRowsDroppedByWatermark"]) for progress in query.recentProgress
               for op in progress["stateOperators"])


def start_live_pricing(bids: DataFrame, sink_path: str, checkpoint_path: str,
                       available_now: bool = True, processing_time: str | None = None
                       ) -> StreamingQuery:
    """Append bids to parquet. ``available_now`` drains what is there and stops (batch-like
    scheduling with streaming state and exactly-once bookkeeping). The ids seen within the
    watermark are kept in RocksDB, outside the executors' heap."""
    bids.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = (bids.writeStream.format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", checkpoint_path))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
