"""Shared helpers of the ``llm`` operators: staging, Arrow batch size, byte buffers.

Intermediates are written as Parquet under the shared folder named by
``spark.checkpoint.dir`` and read back. That cuts the lineage: a lost executor rereads the
files instead of repeating the plan. Nothing is kept on one machine only.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handed to Python at once. Documents may be long, so few rows make a batch.
ARROW_ROWS = 256
#: Text handled at once inside a task, in bytes; bounds a Python worker's memory.
BLOCK_BYTES = 2 << 20

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def staging_root(spark: SparkSession) -> str:
    """The shared folder; one of our own only if none is set and everything is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.setdefault(app, tempfile.mkdtemp(prefix="bidlake-llm-"))
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/llm-stage/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables written by :func:`stage` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_llm_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Hand few rows at once to Python: a batch of 10,000 long texts would not fit. Python
    workers get this package from the driver, wherever they run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="bidlake-code-"), "bidlake-code.zip")
    with zipfile.ZipFile(target, "w") as code:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                code.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over batches, after which a Python worker gives its free memory back to
    the system. Workers wait for further tasks, and several may wait in one executor."""
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterable[pa.RecordBatch], column: str,
           most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Consecutive rows whose ``column`` holds about ``most`` bytes (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = byte_lengths(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + most - size, side="right"))
            stop = min(max(stop, start + (not held)), batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
            if start < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null counts 0."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[
        column.offset:column.offset + len(column) + 1]
    lengths = np.diff(offsets).astype(np.int64)
    if column.null_count:
        lengths[np.asarray(column.is_null())] = 0
    return lengths


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
