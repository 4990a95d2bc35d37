"""Live pricing with the weekly features as state.

The weekly vectors are the initial state of a stateful operator keyed by household: they are
shuffled to the state's partitions once, when the query begins, and stay there in RocksDB. A
micro-batch then shuffles only its own impressions; a restart reads the state, not the table. (In
``realtime.live_features`` a weekly table beyond the broadcast bound is shuffled by every
micro-batch.)

Per household the state holds the weekly vector, the ids priced within the allowed delay, and the
latest event time seen. An impression whose id is among them is a repeated delivery. Ids are
dropped once no accepted delivery of them can come any more: an impression is accepted only after
the latest time of *earlier* batches less the delay (``admission.py``), so ids up to that time of
the household can go.

Every impression comes out once per delivery, with a bid or the reason why not: ``repeated``, ``no
weekly features`` or, with a time-to-live, ``weekly features expired``. New weekly vectors begin a
new query with a new checkpoint.

Every state call is a round trip between the worker and the store, so their number goes with the
households of a micro-batch and not with its impressions: a household with more than ``FEW`` of
them reads all its ids at once and appends the new ones as lists of up to ``CHUNK``. With fewer,
each id is looked up and kept as an entry of its own, and the lists, if any, are read. An id is in
one of the two places.

The state's Python code only compares and remembers; encoding, feature choice and the model are
JVM-side plans before and after it. A hot household's impressions meet in one task: its state is one
place. They are a stream in there, and its memory is the ids of one delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, islice

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..constants import BID_COLUMN, KEY
from ..models.score import check_features
from ..models.train import PREDICTION
from ..operators.encoding import OrdinalEncoding
from .realtime import EVENT_TS, HAS_WEEKLY, NO_WEEKLY, ROCKSDB

REPEATED = "repeated"
EXPIRED = "weekly features expired"
AS_OF = "as_of"
_US = "_event_us"
_REPEAT = "_repeated"
#: A household's impressions in a micro-batch whose ids are looked up and kept one by one.
FEW = 8
#: Ids in one element of a household's list, at most.
CHUNK = 8192


def household_processor(weekly_schema: StructType, names: list[str], delay_us: int,
                        event_id: str = "event_id") -> StatefulProcessor:
    """Attaches the weekly vector to each impression and marks repeated deliveries.

    The class is made here, so it goes to the workers by value: they need not have this package.
    """
    empty = (None,) * len(weekly_schema)
    fields = [f.name for f in weekly_schema]
    out = Row(*names)
    few, chunk, us = FEW, CHUNK, _US

    def packed(ids: dict) -> list[tuple]:
        every = iter(ids.items())
        parts = iter(lambda: list(islice(every, chunk)), [])
        return [([i for i, _ in part], [at for _, at in part]) for part in parts]

    class Household(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.weekly = handle.getValueState("weekly", weekly_schema)
            self.priced = handle.getMapState("priced", "event_id bigint", "event_us bigint")
            self.many = handle.getListState("priced_lists",
                                            "event_ids array<bigint>, event_us array<bigint>")
            self.clock = handle.getValueState("clock", "latest_us bigint, dropped_us bigint")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.weekly.update(tuple(initialState[f] for f in fields))

        def entries(self) -> dict:
            return {known: at for (known,), (at,) in self.priced.iterator()}

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            vector = self.weekly.get()
            latest, dropped = self.clock.get() or (None, None)
            first = list(islice(rows, few + 1))
            bulk = len(first) > few
            drops = latest is not None and (dropped is None or latest - dropped > delay_us)
            listed, single = {}, {}  # without a clock nothing was priced yet
            if latest is not None:
                listed = {i: at for ids, times in self.many.get() for i, at in zip(ids, times)}
                single = self.entries() if bulk or drops else None
            new = {}
            newest = latest
            for row in chain(first, rows):
                at, known = row[us], row[event_id]
                seen = known in new or known in listed or (
                    known in single if single is not None else self.priced.containsKey((known,)))
                if not seen:
                    new[known] = at
                newest = at if newest is None else max(newest, at)
                yield out(*row, vector is not None, seen, *(empty if vector is None else vector))
            if drops:
                until = latest - delay_us
                for known in [i for i, at in single.items() if at <= until]:
                    self.priced.removeKey((known,))
                kept = {i: at for i, at in listed.items() if at > until}
                if not kept and listed:
                    self.many.clear()
                elif len(kept) < len(listed):
                    self.many.put(packed(kept))
                new = {i: at for i, at in new.items() if at > until}
                dropped = latest
            if bulk and new:
                self.many.appendList(packed(new))
            elif not bulk:
                for known, at in new.items():
                    self.priced.updateValue((known,), (at,))
            self.clock.update((newest, dropped))

        def close(self) -> None:
            pass

    return Household()


def delay_micros(spark, delay: str) -> int:
    """An interval's text in microseconds."""
    return spark.range(1).select(F.unix_micros(
        F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {delay}")).alias("us")).first()["us"]


def with_weekly_state(impressions: DataFrame, weekly: DataFrame, delay: str) -> DataFrame:
    """Accepted impressions (``event_id`` and a time never null) with the weekly columns as
    ``_w_<column>``, whether there are any, and whether the delivery is a repeated one."""
    spark = impressions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = [c for c in weekly.columns if c != KEY]
    vector = StructType([weekly.schema[c] for c in columns])
    rows = impressions.withColumn(_US, F.unix_micros(EVENT_TS)).drop(EVENT_TS)
    out = StructType(list(rows.schema.fields)).add(HAS_WEEKLY, "boolean").add(_REPEAT, "boolean")
    for c in columns:
        out = out.add(f"_w_{c}", weekly.schema[c].dataType)
    stated = rows.groupBy(KEY).transformWithState(
        household_processor(vector, out.names, delay_micros(spark, delay)), out, "append", "None",
        initialState=weekly.groupBy(KEY))
    return stated.withColumn(EVENT_TS, F.timestamp_micros(_US)).drop(_US)


def live_bids_stateful(impressions: DataFrame, weekly: DataFrame, encoding: OrdinalEncoding,
                       model: PipelineModel, delay: str,
                       live_columns: Sequence[str] = ("event_type", "prop_k", "UserHourOfWeek"),
                       time_to_live: str | None = None) -> DataFrame:
    """``(ehhn, event_id, event_ts, basebid, reason)``: a row per delivery; ``reason`` is null for
    a priced one. ``weekly`` has one row per household, and with ``time_to_live`` (an interval's
    text) its time ``as_of``: for later impressions the vector is as good as none."""
    to_encode = [c for c in encoding.columns if c in impressions.columns]
    encoded = encoding.transform(impressions, columns=to_encode)
    stated = with_weekly_state(encoded, weekly, delay)
    weekly_cols = [c for c in weekly.columns if c not in (KEY, AS_OF)]
    shown = []
    for c in encoded.columns:
        live = c in weekly_cols and c in live_columns
        shown.append(F.coalesce(F.col(c), F.col(f"_w_{c}")).alias(c) if live else F.col(c))
    shown += [F.col(f"_w_{c}").alias(c) for c in weekly_cols if c not in encoded.columns]
    expired = F.lit(False)
    if time_to_live is not None:
        expired = F.coalesce(F.col(EVENT_TS) > F.col(f"_w_{AS_OF}") + F.expr(
            f"INTERVAL {time_to_live}"), F.lit(False))
    reason = (F.when(F.col(_REPEAT), REPEATED).when(~F.col(HAS_WEEKLY), NO_WEEKLY)
              .when(expired, EXPIRED))
    feats = stated.select(*shown, reason.alias("reason"))
    check_features(feats, model)
    return model.transform(feats).select(
        KEY, "event_id", EVENT_TS,
        F.when(F.col("reason").isNull(), F.col(PREDICTION)).alias(BID_COLUMN), "reason")
