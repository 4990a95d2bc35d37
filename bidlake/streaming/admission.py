"""Late impressions as a second sink.

Structured Streaming drops rows that come later than the watermark without a trace. Here a first
query, the admission, judges lateness itself and loses nothing: each micro-batch is split into
``accepted`` and ``late``, and both are written. Pricing reads ``accepted`` as its stream.

The rule is Spark's: a row is late when its event time is not after the greatest event time of the
*earlier* micro-batches less the allowed delay. That greatest time is kept in a small table next to
the sinks, one row per micro-batch, which the next one reads. A row without an event time can't be
judged and is late.

Exactly once: a micro-batch writes into folders of its own number and replaces them, and the file
with its counts is written last. A batch that a restart repeats holds the same rows, sees the
clock of the batches before it, and so writes the same again. The counts come from one column of
what was written. (Not from ``observe``: a session that holds an ``Observation`` can no longer send
MLlib's classifiers to its tasks, as their training summaries refer to the session.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.broadcast import maybe_broadcast
from .realtime import EVENT_TS

VERDICT = "verdict"
ACCEPTED, LATE = "accepted", "late"
BATCH = "batch"
#: Times are microseconds, which no session time zone can shift on their way over the driver.
#: ``latest_us`` is the greatest time up to and with the batch.
CLOCK = "rows bigint, accepted bigint, late bigint, latest_us bigint"


def rows_path(root: str) -> str:
    return f"{root.rstrip('/')}/rows"


def clock_path(root: str) -> str:
    return f"{root.rstrip('/')}/clock"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def clock(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished micro-batch: batch, rows, accepted, late, latest_us."""
    if not _exists(spark, clock_path(root)):
        return spark.createDataFrame([], f"{CLOCK}, {BATCH} bigint")
    return spark.read.schema(f"{CLOCK}, {BATCH} bigint").parquet(clock_path(root))


def is_late(event_ts: Column, latest: Column, delay: str) -> Column:
    """Whether a row comes too late after ``latest``, which is null before any row was seen."""
    return event_ts.isNull() | F.coalesce(
        event_ts <= latest - F.expr(f"INTERVAL {delay}"), F.lit(False))


def _admit(root: str, delay: str, event_ts: str) -> Callable[[DataFrame, int], None]:
    def admit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = f"{clock_path(root)}/{BATCH}={number - 1}"
        seen = None
        if number > 0 and _exists(spark, last):
            seen = spark.read.schema(CLOCK).parquet(last).first()["latest_us"]
        latest = F.timestamp_micros(F.lit(seen).cast("bigint"))
        judged = batch.withColumn(VERDICT, F.when(is_late(
            F.col(event_ts), latest, delay), LATE).otherwise(ACCEPTED))
        path = f"{rows_path(root)}/{BATCH}={number}"
        judged.write.mode("overwrite").partitionBy(VERDICT).parquet(path)
        got = spark.read.schema(judged.schema).parquet(path).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(VERDICT) == ACCEPTED).alias("accepted"),
            F.count_if(F.col(VERDICT) == LATE).alias("late"),
            F.max(F.unix_micros(event_ts)).alias("latest_us")).first()
        newest = max((t for t in (seen, got["latest_us"]) if t is not None), default=None)
        spark.createDataFrame(
            [(got["rows"], got["accepted"], got["late"], newest)], CLOCK
        ).coalesce(1).write.mode("overwrite").parquet(f"{clock_path(root)}/{BATCH}={number}")
    return admit


def start_admission(impressions: DataFrame, root: str, checkpoint_path: str, delay: str,
                    event_ts: str = EVENT_TS, available_now: bool = True,
                    processing_time: str | None = None) -> StreamingQuery:
    """Split a stream of impressions into accepted and late ones under ``root``. ``delay`` is an
    interval's text (``1 hour``)."""
    writer = impressions.writeStream.option("checkpointLocation", checkpoint_path).foreachBatch(
        _admit(root, delay, event_ts))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def _finished(spark: SparkSession, root: str, verdict: str, schema: StructType | str) -> DataFrame:
    done, _ = maybe_broadcast(clock(spark, root).select(BATCH))
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType(list(fields.fields)).add(BATCH, "long").add(VERDICT, "string")
    if not _exists(spark, rows_path(root)):
        return spark.createDataFrame([], fields)
    # an unfinished batch has no row in the clock
    return (spark.read.schema(whole).parquet(rows_path(root)).where(F.col(VERDICT) == verdict)
            .join(done, BATCH, "left_semi").drop(VERDICT, BATCH))


def late_impressions(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The late rows of all finished micro-batches."""
    return _finished(spark, root, LATE, schema)


def accepted_impressions(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The accepted rows of all finished micro-batches."""
    return _finished(spark, root, ACCEPTED, schema)


def accepted_stream(spark: SparkSession, root: str, schema: StructType | str,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """The accepted rows as a stream. Files of a batch that is written again get new names, so
    start it on what an admission has finished (``availableNow`` after it), or accept that a
    failed batch's rows come twice; pricing knows a repeated impression by its id."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType(list(fields.fields)).add(BATCH, "long").add(VERDICT, "string")
    reader = spark.readStream.schema(whole)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(rows_path(root)).where(F.col(VERDICT) == ACCEPTED).drop(VERDICT, BATCH)
