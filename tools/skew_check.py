"""Hot-key experiment: one household holds a third of all impressions.

Builds a skewed log from the events table (rows replicated with ``explode(sequence)``,
a third of them moved to one household), stages it as several files, then runs
"latest impression per audience household" two ways with no broadcast allowed:

* ``bidlake``: ``latest_within_keys`` (window with map-side group limit, then semi join);
* ``naive``: shuffled semi join first, then the window.

From the event log it prints, per query, the largest number of shuffle records one task
read and the median, i.e. how much of the hot key reached a single task.

usage: python tools/skew_check.py [sf_dir] [replicas]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from pyspark.sql import functions as F  # noqa: E402

from bidlake.operators.latest import latest_per_key, latest_within_keys  # noqa: E402
from bidlake.session import build_session, stage_path  # noqa: E402
from bidlake.sources.files import write_parquet  # noqa: E402
from task_times import _lines  # noqa: E402

HOT = -1


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    reps = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    log_dir = tempfile.mkdtemp(prefix="skew-evlog-", dir="/tmp")
    spark = build_session("local[8]", 8, event_log_dir=log_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = ev.select("event_id", "user_id", "ts", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    skewed = rows.select(
        (F.col("event_id") * reps + F.col("rep")).alias("event_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit(HOT))
        .otherwise(F.col("user_id") * 1000 + F.col("rep")).alias("ehhn"),
        F.col("ts").alias("LogEntryTime"))
    path = stage_path(spark, "skewed-log")
    write_parquet(skewed.repartition(16), path)
    log = spark.read.parquet(path)
    keys = log.select("ehhn").distinct()
    n = log.count()

    sc = spark.sparkContext
    sc.setJobGroup("bidlake", "bidlake")
    a = latest_within_keys(log, keys, "ehhn", "LogEntryTime", "event_id", max_broadcast_bytes=0)
    a.write.format("noop").mode("overwrite").save()
    sc.setJobGroup("naive", "naive")
    b = latest_per_key(log.join(keys, "ehhn", "left_semi"), "ehhn", "LogEntryTime", "event_id")
    b.write.format("noop").mode("overwrite").save()
    assert sorted(a.collect()) == sorted(b.collect())

    # Training rows: the whole log joined once to one row per household. AQE's skew
    # thresholds are scaled down to this test's size (defaults assume >= 256 MB parts).
    # Staged, so the join's right side is a plain scan and both sides read a shuffle
    # directly (AQE's skew split needs that shape).
    households = spark.read.parquet(write_parquet(
        keys.withColumn("ngr_score", F.lit(1.0)), stage_path(spark, "households")))
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1MB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    for group, skew in (("join-aqe-skew", "true"), ("join-no-skew", "false")):
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", skew)
        sc.setJobGroup(group, group)
        log.join(households, "ehhn").write.format("noop").mode("overwrite").save()
    spark.stop()

    job_group: dict[int, str] = {}
    stage_group: dict[int, str] = {}
    records: dict[str, list[int]] = defaultdict(list)
    evlog = os.path.join(log_dir, os.listdir(log_dir)[0])
    for line in _lines(evlog):
        e = json.loads(line)
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id")
            if group:
                job_group[e["Job ID"]] = group
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = group
        elif kind == "SparkListenerTaskEnd" and e["Stage ID"] in stage_group:
            m = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
            r = m.get("Total Records Read", 0)
            if r:
                records[stage_group[e["Stage ID"]]].append(r)
    print(f"log rows: {n}, hot household rows: about {n // 3}")
    for group in ("bidlake", "naive", "join-aqe-skew", "join-no-skew"):
        rs = records[group]
        print(f"{group:14s} shuffle-reading tasks={len(rs):3d}  max records/task={max(rs):8d}  "
              f"median={statistics.median(rs):8.0f}")


if __name__ == "__main__":
    main()
