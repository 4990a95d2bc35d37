import re

import pytest
from planutil import plan_text
from pyspark.errors import AnalysisException

from bidlake.session import run_stamp, stage_path
from bidlake.sources.files import freed_shuffles, read_partition, stage, write_parquet


def test_repeated_stamp_fails(spark):
    df = spark.range(3)
    path = stage_path(spark, "twice")
    write_parquet(df, path)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_parquet(df, path)


def test_partition_scan_prunes(spark):
    df = spark.range(20).selectExpr("id", "CAST(id % 2 AS STRING) AS channel_type",
                                    "CAST(id % 3 AS INT) AS cycle")
    root = stage_path(spark, "tree")
    write_parquet(df, root, partition_by=["channel_type", "cycle"])
    leaf = read_partition(spark, root, channel_type="1", cycle=2)
    assert sorted(r.id for r in leaf.collect()) == [5, 11, 17]
    assert set(leaf.columns) == {"id", "channel_type", "cycle"}
    plan = plan_text(leaf)
    assert re.search(r"PartitionFilters: \[.+\]", plan)
    with pytest.raises(ValueError):
        read_partition(spark, root, nope=1)


def test_stage_round_trip(spark):
    df = spark.range(5)
    assert sorted(r.id for r in stage(df, "rt").collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("before", ["true", "false", None])
def test_freed_shuffles_leaves_the_setting(spark, before):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name, None)
    if before:
        spark.conf.set(name, before)
    at = spark.conf.get(name, None)
    try:
        with pytest.raises(KeyError), freed_shuffles(spark):
            assert spark.conf.get(name) == "true"
            raise KeyError
        assert spark.conf.get(name, None) == at
    finally:
        if kept:
            spark.conf.set(name, kept)
        else:
            spark.conf.unset(name)


def test_run_stamp_format(spark):
    from bidlake.session import run_stamp_column

    assert re.fullmatch(r"\d{10}", run_stamp())
    assert run_stamp(0) == "0101197000"
    row = spark.sql("SELECT TIMESTAMP_NTZ'2023-07-30 13:45:00' AS ts").select(
        run_stamp_column("ts").alias("s")).first()
    assert row.s == "0730202313"


def test_cohort_csv_round_trip_keeps_nulls(spark):
    from bidlake.sources.files import read_cohorts, write_csv

    df = spark.createDataFrame([(1, 0.5, "A"), (2, None, "A"), (3, 0.7, "B")],
                               "ehhn bigint, ngr_score double, cohort string")
    root = write_csv(df, stage_path(spark, "csv"), partition_by=["cohort"])
    back = read_cohorts(spark, {c: f"{root}/cohort={c}" for c in ("A", "B")},
                        "ehhn bigint, ngr_score double")
    assert sorted(back.collect()) == sorted(df.collect())


def test_scores_sink_layout(spark):
    import os

    from bidlake.plans.scoring import write_scores

    df = spark.createDataFrame([(1, "A", 1, 0.2), (2, "B", 1, 0.9)],
                               "ehhn bigint, cohort string, week int, sales_conversion double")
    root = write_scores(df, stage_path(spark, "scores"))
    assert sorted(os.listdir(root + "/cohort=A")) == ["week=1"]
    files = os.listdir(root + "/cohort=B/week=1")
    assert any(f.endswith(".csv") for f in files)


def test_latest_partition(spark):
    from bidlake.sources.files import latest_partition

    df = spark.range(12).selectExpr("id", "CAST(id % 2 AS STRING) AS channel_type",
                                    "date_add(DATE'2023-06-01', CAST(id % 3 AS INT)) AS cycle_date")
    root = stage_path(spark, "latest-tree")
    write_parquet(df, root, partition_by=["channel_type", "cycle_date"])
    got = latest_partition(spark, root, "cycle_date", channel_type="1")
    assert sorted(r.id for r in got.collect()) == [5, 11]


def test_latest_partition_lists_no_other_leaf(spark, monkeypatch):
    """Of 3 channels and 40 weeks, the root, one channel and one leaf are listed."""
    from bidlake.sources import files

    df = spark.range(240).selectExpr("id", "CAST(id % 3 AS STRING) AS channel_type",
                                     "CAST(id % 40 + 1 AS INT) AS week")
    root = stage_path(spark, "listed-tree")
    write_parquet(df.repartition(1), root, partition_by=["channel_type", "week"])
    listed = []
    children = files._children
    monkeypatch.setattr(files, "_children", lambda s, d: listed.append(d) or children(s, d))
    got = files.latest_partition(spark, root, "week", channel_type="1")
    assert {(r.channel_type, r.week) for r in got.collect()} == {(1, 40)}
    assert [d.split("listed-tree")[-1].split("/", 1)[-1] for d in listed][1:] == [
        "channel_type=1", "channel_type=1/week=40"]
    assert all("channel_type=1/week=40/" in f for f in got.inputFiles())
    # over all channels: the newest week of any
    assert {r.week for r in files.latest_partition(spark, root, "week").collect()} == {40}


def test_latest_partition_without_files_or_values(spark):
    from bidlake.sources import files

    df = spark.createDataFrame([(1, 9), (2, 10), (3, None)], "x int, week int")
    root = stage_path(spark, "gaps-tree")
    write_parquet(df, root, partition_by=["week"])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/week=11")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    assert [r.x for r in files.latest_partition(spark, root, "week").collect()] == [2]
    assert files.latest_partition(spark, root, "week", week="77").count() == 0
