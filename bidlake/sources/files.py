"""Parquet and CSV sources and sinks.

Readers return lazy DataFrames so Catalyst can prune columns and push filters into the
scan. Writers fail when the target exists unless told otherwise: two runs with the same
stamp must not silently overwrite each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stage_path


#: Directory value that stands for a null partition value.
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def read_parquet(spark: SparkSession, path: str | Sequence[str],
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet dataset scan; ``columns`` become the scan's ReadSchema."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_partition(spark: SparkSession, root: str, **partition_values) -> DataFrame:
    """One leaf of a Hive-partitioned tree, read through the root so the partition
    columns stay in the schema and the filter prunes directories (``PartitionFilters``)."""
    df = spark.read.parquet(root)
    missing = [k for k in partition_values if k not in df.columns]
    if missing:
        raise ValueError(f"not partition columns of {root}: {missing}")
    cond: Column | None = None
    for name, value in partition_values.items():
        term = F.col(name) == F.lit(value)
        cond = term if cond is None else cond & term
    return df.where(cond) if cond is not None else df


def _children(spark: SparkSession, directory: str) -> list[tuple[str, bool]]:
    """(path, is a folder) of what lies in one directory, by the Hadoop file system; hidden names
    (``_``, ``.``) aside."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    return [(f.getPath().toString(), f.isDirectory()) for f in found
            if not f.getPath().getName().startswith(("_", "."))]


def _level(spark: SparkSession, directory: str, fixed: Mapping[str, str]
           ) -> list[tuple[str, str, str]]:
    """(folder, column, value) of a directory's partition folders that agree with ``fixed``."""
    out = []
    for path, folder in _children(spark, directory):
        column, equals, value = path.rstrip("/").rsplit("/", 1)[-1].partition("=")
        column, value = unquote(column), unquote(value)
        if folder and equals and fixed.get(column, value) == value:
            out.append((path, column, value))
    return out


def _has_file(spark: SparkSession, directory: str) -> bool:
    children = _children(spark, directory)
    return any(not folder for _, folder in children) or any(
        _has_file(spark, path) for path, folder in children if folder)


def _newest_first(values: set[str]) -> list[str]:
    """Numbers as numbers, all others (ISO dates too) as texts, descending."""
    try:
        return sorted(values, key=float, reverse=True)
    except ValueError:
        return sorted(values, reverse=True)


def latest_partition(spark: SparkSession, root: str, partition_col: str,
                     **fixed_values) -> DataFrame:
    """Read the newest value of ``partition_col`` (e.g. the latest ``cycle_date``) that has files.

    Directories are listed one level at a time, and only where the fixed values lead; below the
    newest value's folders Spark lists the files. So a tree of any number of channels and weeks
    costs one listing per level, and no name of another leaf's file goes to the driver. Numbers
    compare as numbers, dates and texts as texts; the null partition is never the newest.
    """
    fixed = {k: str(v) for k, v in fixed_values.items()}
    level = [root]
    while level:
        below = [x for directory in level for x in _level(spark, directory, fixed)]
        newest = {v for _, column, v in below if column == partition_col}
        if newest:
            for value in _newest_first(newest - {DEFAULT_PARTITION}):
                leaves = [path for path, column, v in below
                          if column == partition_col and v == value
                          and _has_file(spark, path)]
                if leaves:
                    df = spark.read.option("basePath", root).parquet(*leaves)
                    kind = df.schema[partition_col].dataType
                    return df.where(F.col(partition_col) == F.lit(value).cast(kind))
            break
        level = [path for path, _, _ in below]
    return read_partition(spark, root, **fixed_values).where(F.lit(False))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str,
             header: bool = True) -> DataFrame:
    """S3: CSV with a header and an explicit schema (no inference pass)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(paths)


def read_cohorts(spark: SparkSession, paths: Mapping[str, str], schema: StructType | str,
                 cohort_col: str = "cohort", fmt: str = "csv") -> DataFrame:
    """Same-shaped files for several cohorts as one DataFrame with a cohort column."""
    frames = []
    for cohort, path in paths.items():
        if fmt == "csv":
            df = read_csv(spark, path, schema)
        else:
            df = spark.read.schema(schema).format(fmt).load(path)
        frames.append(df.withColumn(cohort_col, F.lit(cohort)))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: Sequence[str] | None = None) -> str:
    """K1: parquet sink; by default fails with PATH_ALREADY_EXISTS on a repeated stamp."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists",
              partition_by: Sequence[str] | None = None, header: bool = True) -> str:
    """K2/K3: CSV sink with a header; no row-index column. ``partition_by`` puts e.g. the
    cohort and week into the directory names instead of the file name."""
    writer = df.write.mode(mode).option("header", header)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def stage(df: DataFrame, name: str, partition_by: Sequence[str] | None = None) -> DataFrame:
    """S5 + K1: materialise an intermediate as parquet under the shared checkpoint folder
    and continue from the written copy. This cuts lineage (a lost executor re-reads the
    file instead of recomputing the plan) and lets later actions reuse the result."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    write_parquet(df, path, partition_by=partition_by)
    return spark.read.parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """A write inside gives back the disk of its shuffles as soon as it is done. By default they stay
    until the driver happens to collect its garbage, so those of many small steps add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
