"""Session construction and the shared staging folder.

On a cluster the staging folder is the one named by ``spark.checkpoint.dir`` (a shared
file system path). Only when that is unset (local runs, tests) do we create our own.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .constants import RUN_STAMP_PYTHON, RUN_STAMP_SPARK

_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "bidlake", driver_memory: str | None = None,
                  event_log_dir: str | None = None) -> SparkSession:
    """A session tuned for this workload.

    AQE coalesces small shuffles and splits skewed join partitions at run time;
    the UI is off (no HTTP server); timestamps are compared in UTC. ``event_log_dir``
    turns on Spark's event log (stage and task times for offline inspection). Master, shuffle
    partitions and driver memory are set only if given: on a cluster they come from the
    submit command.
    """
    builder = (
        SparkSession.builder
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    given = {"spark.master": master, "spark.sql.shuffle.partitions": shuffle_partitions,
             "spark.driver.memory": driver_memory}
    for name, value in given.items():
        if value is not None:
            builder = builder.config(name, str(value))
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getCheckpointDir()
    if conf_dir:
        return conf_dir
    if not is_local(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach; "
                           "bidlake stages intermediates there")
    # Local/test fallback only: one process, so a temporary folder is shared by all tasks.
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[key] = tempfile.mkdtemp(prefix="bidlake-ckpt-")
    path = _LOCAL_FALLBACK[key]
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def is_local(master: str) -> bool:
    """Whether all tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def stage_root(spark: SparkSession) -> str:
    """This application's own part of the staging folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/bidlake-stage/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared staging folder for one materialised table."""
    return f"{stage_root(spark)}/{name}-{run_stamp()}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete everything this application has staged. Call it when a run's outputs are
    written: plans that read staged tables no longer work afterwards."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def run_stamp(at: float | None = None) -> str:
    """Run stamp with hour resolution (month, day, year, hour), computed once per run."""
    return time.strftime(RUN_STAMP_PYTHON, time.gmtime(at if at is not None else time.time()))


def run_stamp_column(ts: Column | str) -> Column:
    """The same stamp computed on the executors from a timestamp column (e.g. to tag
    rows by the hour they were produced)."""
    return F.date_format(ts if isinstance(ts, Column) else F.col(ts), RUN_STAMP_SPARK)
