"""Admission (late rows as a sink) and pricing with the weekly vectors as state."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bidlake.models.train import train_regressors
from bidlake.operators.encoding import ordinal_fit
from bidlake.session import stage_path
from bidlake.sources.files import stage, write_parquet
from bidlake.streaming import admission, realtime, stateful

T0 = dt.datetime(2024, 1, 1, 12, 0)


def deliver(spark, path, files):
    """One file per list of (event_id, minutes, household)."""
    for rows in files:
        data = [(i, None if m is None else T0 + dt.timedelta(minutes=m), h, "click", 1.0,
                 '{"k": 1}') for i, m, h in rows]
        write_parquet(spark.createDataFrame(data, realtime.EVENTS_SCHEMA).coalesce(1), path,
                      mode="append")
        time.sleep(1.1)  # files are read in the order of their times


def judge(files, minutes):
    """(accepted, late) ids by the rule, file by file."""
    accepted, late, latest = [], [], None
    for rows in files:
        for i, m, _ in rows:
            too_late = m is None or (latest is not None and m <= latest - minutes)
            (late if too_late else accepted).append(i)
        times = [m for _, m, _ in rows if m is not None]
        latest = max([*times, *([] if latest is None else [latest])], default=None)
    return sorted(accepted), sorted(late)


def admit(spark, src, root, checkpoint):
    stream = realtime.impression_stream(spark, src, max_files_per_trigger=1)
    admission.start_admission(stream, root, checkpoint, "1 hour").awaitTermination()
    return stream.schema


def test_late_rows_are_kept_and_counted(spark):
    rng = random.Random(2)
    files = [[(100 * k + j, 30 * k + rng.randint(-150, 30), j % 3) for j in range(12)]
             for k in range(4)]
    files[2].append((999, None, 1))
    src, root = stage_path(spark, "admit-src"), stage_path(spark, "admitted")
    checkpoint = stage_path(spark, "admit-ckpt")
    deliver(spark, src, files[:2])
    admit(spark, src, root, checkpoint)
    deliver(spark, src, files[2:])
    schema = admit(spark, src, root, checkpoint)  # a restart goes on with the same clock
    accepted, late = judge(files, 60)
    assert late and 999 in late
    got = [sorted(r["event_id"] for r in f(spark, root, schema).collect())
           for f in (admission.accepted_impressions, admission.late_impressions)]
    assert got == [accepted, late]
    counts = admission.clock(spark, root).orderBy("batch").collect()
    assert [r["rows"] for r in counts] == [len(f) for f in files]
    assert sum(r["accepted"] for r in counts) == len(accepted)
    assert sum(r["late"] for r in counts) == len(late)


def test_a_batch_that_is_repeated_changes_nothing(spark):
    root = stage_path(spark, "again")
    rows = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(hours=3))],
                                 "event_id int, event_ts timestamp")
    write = admission._admit(root, "1 hour", "event_ts")
    write(rows, 0)
    write(rows, 1)   # now the first row is late
    write(rows, 1)
    write(rows, 0)   # the clock of later batches doesn't count
    assert [(r["batch"], r["accepted"], r["late"]) for r in
            admission.clock(spark, root).orderBy("batch").collect()] == [(0, 2, 0), (1, 1, 1)]
    assert admission.late_impressions(spark, root, rows.schema).count() == 1
    assert admission.accepted_impressions(spark, root, rows.schema).count() == 3


def test_nothing_admitted_yet(spark):
    root = stage_path(spark, "nothing")
    assert admission.clock(spark, root).collect() == []
    assert admission.late_impressions(spark, root, "event_id int").collect() == []


@pytest.fixture(scope="module")
def priced(spark):
    train = spark.createDataFrame([(i, ["click", "view"][i % 2], str(i % 3), float(i))
                                   for i in range(40)],
                                  "o int, event_type string, prop_k string, y double")
    enc = ordinal_fit(train, ["event_type", "prop_k"], "o")
    rows = enc.transform(train).withColumn("fixed", (F.col("o") % 5).cast("double")).withColumn(
        "y", F.col("fixed") * 10 + F.col("event_type"))
    model = train_regressors(rows, rows, ["event_type", "fixed"], "y", {"LM": None}).best
    return enc, model


def run(spark, stream, weekly, priced, sink, checkpoint, **more):
    enc, model = priced
    bids = stateful.live_bids_stateful(stream, weekly, enc, model, "1 hour", **more)
    query = realtime.start_live_pricing(bids, sink, checkpoint)
    query.awaitTermination()
    return query


def test_state_survives_a_restart_and_weekly_is_read_once(spark, priced):
    src, sink, ckpt = (stage_path(spark, f"state-{x}") for x in ("src", "sink", "ckpt"))
    weekly = stage(spark.createDataFrame([(10, 1.0), (11, 2.0)], "ehhn bigint, fixed double"),
                   "weekly")
    deliver(spark, src, [[(1, 0, 10), (1, 0, 10), (2, 1, 99)], [(3, 5, 11), (1, 0, 10)]])

    def stream():
        return realtime.impression_stream(spark, src, max_files_per_trigger=1)

    run(spark, stream(), weekly, priced, sink, ckpt)
    deliver(spark, src, [[(3, 5, 11), (4, 200, 10)], [(5, 400, 10), (2, 1, 99)]])
    # other weekly values now: the state began with the first ones and keeps them
    other = stage(weekly.withColumn("fixed", F.lit(50.0)), "weekly")
    query = run(spark, stream(), other, priced, sink, ckpt)
    out = spark.read.parquet(sink).collect()
    assert sorted((r["event_id"], r["reason"]) for r in out if r["reason"]) == [
        (1, "repeated"), (1, "repeated"), (2, "no weekly features"), (2, "repeated"),
        (3, "repeated")]
    bids = {r["event_id"]: r["basebid"] for r in out if r["reason"] is None}
    assert {i: pytest.approx(b, abs=1e-6) for i, b in bids.items()} == {
        1: 11.0, 3: 21.0, 4: 11.0, 5: 11.0}
    assert len(out) == 9
    # the last batch's plan: nothing was read from the weekly table
    plan = query._jsq.streamingQuery().lastExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = [leaves.apply(k) for k in range(leaves.size())]
    rows = [int(p.metrics().apply("numOutputRows").value()) for p in read
            if "weekly" in p.toString() and p.metrics().contains("numOutputRows")]
    assert sum(rows) == 0


def test_ids_are_forgotten_after_the_delay(spark, priced):
    """A household's old ids leave the state when an accepted delivery of them can't come."""
    src, sink, ckpt = (stage_path(spark, f"forget-{x}") for x in ("src", "sink", "ckpt"))
    weekly = spark.createDataFrame([(10, 1.0)], "ehhn bigint, fixed double")
    deliver(spark, src, [[(k, k, 10) for k in range(5)], [(50, 300, 10)], [(51, 301, 10)]])
    stream = realtime.impression_stream(spark, src, max_files_per_trigger=1)
    run(spark, stream, weekly, priced, sink, ckpt)
    held = (spark.read.format("statestore").option("path", ckpt)
            .option("stateVarName", "priced").load())
    assert sorted(r["event_id"] for r in held.select("user_map_key.event_id" if
                  "user_map_key" in held.columns else "key.event_id").collect()) == [50, 51]


def test_weekly_features_expire(spark, priced):
    src, sink, ckpt = (stage_path(spark, f"ttl-{x}") for x in ("src", "sink", "ckpt"))
    weekly = spark.createDataFrame([(10, 1.0, T0), (11, 2.0, None)],
                                   "ehhn bigint, fixed double, as_of timestamp")
    deliver(spark, src, [[(1, 60, 10), (2, 60 * 24 * 8, 10), (3, 60 * 24 * 8, 11)]])
    run(spark, realtime.impression_stream(spark, src), weekly, priced, sink, ckpt,
        time_to_live="7 days")
    got = {r["event_id"]: r["reason"] for r in spark.read.parquet(sink).collect()}
    assert got == {1: None, 2: "weekly features expired", 3: None}


class Held:
    """Value, list and map states in memory that count their calls."""

    def __init__(self):
        self.calls, self.states = 0, {}

    def _state(self, name, empty):
        held = self

        class State:
            kept = empty

            def __getattribute__(self, attribute):
                if attribute != "kept":
                    held.calls += 1
                return object.__getattribute__(self, attribute)

            def get(self):
                return iter(self.kept) if isinstance(self.kept, list) else self.kept

            def update(self, value):
                self.kept = value

            put = update

            def clear(self):
                self.kept = []

            def exists(self):
                return self.kept is not None

            def appendList(self, values):
                self.kept = self.kept + values

            def iterator(self):
                return iter(list(self.kept.items()))

            def keys(self):
                return iter(list(self.kept))

            def getValue(self, key):
                return self.kept.get(key)

            def containsKey(self, key):
                return key in self.kept

            def updateValue(self, key, value):
                self.kept[key] = value

            def removeKey(self, key):
                del self.kept[key]

        self.states[name] = State()
        return self.states[name]

    def getValueState(self, name, schema):
        return self._state(name, None)

    def getListState(self, name, schema):
        return self._state(name, [])

    def getMapState(self, name, key, value):
        return self._state(name, {})


def household(delay, names=("event_id", stateful._US, "weekly", "repeated", "_w_fixed")):
    held = Held()
    processor = stateful.household_processor(
        StructType([StructField("fixed", DoubleType())]), list(names), delay)
    processor.init(held)
    row = Row("event_id", stateful._US)

    def batch(deliveries):
        return [r["repeated"] for r in processor.handleInputRows(
            (1,), iter([row(*d) for d in deliveries]), None)]
    return batch, held


def test_state_calls_do_not_grow_with_impressions(spark):
    batch, held = household(1000)
    assert batch([(k % 5000, k % 5000) for k in range(6000)]) == [False] * 5000 + [True] * 1000
    assert batch([(4000 + k, 4000 + k) for k in range(6000)]) == [True] * 1000 + [False] * 5000
    assert batch([(9000 + k, 9000 + k) for k in range(2000)]) == [True] * 1000 + [False] * 1000
    assert held.calls <= 40


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_remembered_in_small_and_large_deliveries(spark, monkeypatch, seed):
    """Against one plain dictionary of ids, with the same rule of forgetting."""
    monkeypatch.setattr(stateful, "CHUNK", 3)
    rng = random.Random(seed)
    delay, known, latest, dropped = 60, {}, None, None
    batch, held = household(delay)
    for turn in range(40):
        rows = [(rng.randint(0, 150), 20 * turn + rng.randint(-50, 20))
                for _ in range(rng.choice([1, 2, 8, 9, 10, 30]))]
        expected, newest = [], latest
        for i, at in rows:
            expected.append(i in known)
            known.setdefault(i, at)
            newest = at if newest is None else max(newest, at)
        assert batch(rows) == expected
        if latest is not None and (dropped is None or latest - dropped > delay):
            known = {i: at for i, at in known.items() if at > latest - delay}
            dropped = latest
        latest = newest
        lists = [x for part in held.states["priced_lists"].kept for x in zip(*part)]
        assert all(len(part[0]) <= 3 for part in held.states["priced_lists"].kept)
        single = [(i, at) for (i,), (at,) in held.states["priced"].kept.items()]
        assert sorted(lists + single) == sorted(known.items())
