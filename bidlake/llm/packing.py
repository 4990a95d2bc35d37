"""Packing by non-negative least squares over shallow length combinations (operator 7).

1. Each document becomes token ids and an end id. Full windows are sequences of their own;
   the rest (1 to window - 1 ids) has to be packed. Pieces leave the tokenizing task with
   their checksums, so ids are never stored or shuffled.
2. The lengths of the rests form a histogram of at most ``window`` bins, whatever the input.
   On the driver, all combinations of two or three lengths that fill a window are enumerated,
   and non-negative least squares finds how often to use each so that the histogram is met
   best. Counts are rounded down and capped by what is there; what is left of pairs and
   triples is taken greedily, commonest lengths first.
3. Residual rests, longest first, are laid end to end and cut at each window's end, so only
   the last sequence of all is padded. A cut rest is tokenized again for the checksums of its
   parts; there is one cut a residual window at most.
4. A rest's place follows from its length and its rank among the rests of that length, by a
   table of rank ranges. Ranks come from ranks inside a task plus the counts of earlier tasks
   (one row per task and length), so no length, however common, is sorted in one task.

Ids equal those of the ``tokenizers`` library for ``byte_bpe_50k.json``; they are computed with
``tiktoken`` from the same vocabulary as ranks, which is four times as fast (tests compare the
two). Special tokens in a text become their id, as ``tokenizers`` does by default.

Defined results: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, stage

WINDOW = 1024
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
#: Rounds of the least-squares solver.
ROUNDS = 400

_ENCODINGS: dict[str, object] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(ranks_path: str):
    """The byte-level BPE, loaded once in each Python worker."""
    if ranks_path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[ranks_path] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens=SPECIAL)
    return _ENCODINGS[ranks_path]


def token_ids(text: str | None, ranks_path: str) -> np.ndarray:
    """Ids of a whole text and the end id, as little-endian unsigned 32-bit numbers."""
    if not text:
        return np.array([END_ID], "<u4")
    got = encoding(ranks_path).encode_to_numpy(text, allowed_special="all")
    return np.append(got, END_ID).astype("<u4")


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """All a <= b <= c with a + b + c = window over the present lengths; a = 0 makes a pair."""
    first = np.concatenate([[0], present])
    a, b = np.meshgrid(first, present, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    ok = (a <= b) & (b <= c)
    a, b, c = a[ok], b[ok], c[ok]
    there = np.zeros(window + 1, bool)
    there[present] = True
    ok = there[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def solve(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """min |A x - counts| over x >= 0, A's columns being the patterns (length 0 is no row).

    Multiplicative updates x *= (A'h) / (A'A x): all terms are non-negative, so x stays so.
    """
    target = counts.astype(float).copy()
    target[0] = 0
    gain = target[patterns].sum(1)
    x = gain / max(1.0, float(len(patterns)))
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]),
                           minlength=len(counts))
        made[0] = 0
        x = x * gain / np.maximum(made[patterns].sum(1), 1e-12)
    return x


def plan(histogram: dict[int, int], window: int = WINDOW):
    """How to place the rests: rows (length, from_rank, upto_rank, sequence, offset, residual).

    A rest of that length whose rank is in [from_rank, upto_rank) goes, if it isn't residual,
    to sequence ``sequence + rank - from_rank`` at ``offset``. Residual rests lie end to end
    from position ``offset`` of a stream. Also returns the number of sequences that patterns
    fill; the stream's sequences follow.
    """
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(window + 1, np.int64)
    rows, sequence = [], 0
    present = np.flatnonzero(counts)
    patterns = combinations(window, present) if len(present) else np.zeros((0, 3), np.int64)
    if len(patterns):
        x = solve(patterns, counts)
        again = np.argsort(-counts[patterns].min(1, where=patterns > 0,
                                                 initial=counts.max()), kind="stable")
        rounds = [(k, int(x[k])) for k in np.argsort(-x, kind="stable") if x[k] >= 1]
        for k, most in [*rounds, *((k, None) for k in again)]:
            parts = [int(v) for v in patterns[k] if v]
            need = {v: parts.count(v) for v in parts}
            there = min((int(counts[v]) - int(used[v])) // n for v, n in need.items())
            take = there if most is None else min(most, there)
            if take <= 0:
                continue
            offset = 0
            for v in parts:
                rows.append((v, int(used[v]), int(used[v]) + take, sequence, offset, False))
                used[v] += take
                offset += v
            sequence += take
    at = 0
    for v in map(int, present[::-1]):
        left = int(counts[v]) - int(used[v])
        if left:
            rows.append((v, int(used[v]), int(counts[v]), 0, at, True))
            at += left * v
    return rows, sequence


def first_pieces(batches: Iterator[pa.RecordBatch], ranks_path: str,
                 window: int) -> Iterator[pa.RecordBatch]:
    """One row per full window and rest, with its rank inside this task."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    seen = np.zeros(window + 1, np.int64)
    for batch in batches:
        out = []
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        keys = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        marks = batch.column(batch.schema.get_field_index("mark")).to_pylist()
        for key, mark, text in zip(keys, marks, texts, strict=True):
            ids = token_ids(text, ranks_path)
            data = memoryview(ids.tobytes())
            for start in range(0, len(ids), window):
                length = min(window, len(ids) - start)
                crc = zlib.crc32(data[4 * start:4 * (start + length)])
                out.append((key, mark, start, length, crc, len(ids), task, int(seen[length])))
                seen[length] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 8)],
            ["doc_id", "mark", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])


def recut(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Checksums of the parts [start, start + length) of documents."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            data = memoryview(token_ids(row["text"], ranks_path).tobytes())
            for start, length in {(p["start"], p["length"]) for p in row["parts"]}:
                out.append((row["doc_id"], row["mark"], start, length,
                            zlib.crc32(data[4 * start:4 * (start + length)])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)],
            ["doc_id", "mark", "start", "length", "crc"])


def pack(documents: DataFrame, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``documents`` (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    small_batches(spark)
    path = ranks_path or default_ranks()
    # two hashes tell repeated doc_ids with other texts apart when parts are matched again
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    pieces = stage(texts.mapInArrow(
        lean(lambda batches: first_pieces(batches, path, window)),
        "doc_id bigint, mark bigint, start bigint, length bigint, ids_crc32 bigint, "
        "doc_tokens bigint, task bigint, rank bigint"), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranked = (pieces.join(offsets.drop("n"), ["length", "task"])
              .withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before"))
    histogram = {r["length"]: r["n"] for r in
                 by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(window, 0)
    rows, patterned = plan(histogram, window)
    table = F.broadcast(spark.createDataFrame(
        rows, "length bigint, from_rank bigint, upto_rank bigint, sequence bigint, "
              "at bigint, residual boolean"))
    placed = ranked.where(F.col("length") < window).join(table, "length").where(
        (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("upto_rank")))
    base = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    step = F.col("rank") - F.col("from_rank")
    whole = ranked.where(F.col("length") == window).select(
        *base, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    fitted = placed.where(~F.col("residual")).select(
        *base, (F.lit(full) + F.col("sequence") + step).alias("sequence_id"),
        F.col("at").alias("offset"))
    stream = placed.where("residual").withColumn("at", F.col("at") + step * F.col("length"))
    room = F.lit(window) - F.pmod("at", F.lit(window))
    part = F.struct(
        F.lit(0).cast("long").alias("skip"), F.least("length", room).alias("size"))
    second = F.struct(room.alias("skip"), (F.col("length") - room).alias("size"))
    parts = stream.withColumn("part", F.explode(F.when(
        F.col("length") > room, F.array(part, second)).otherwise(F.array(part))))
    position = F.col("at") + F.col("part.skip")
    laid = parts.select(
        "doc_id", "mark", (F.col("start") + F.col("part.skip")).alias("start"),
        F.col("part.size").alias("length"),
        F.when(F.col("part.size") == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"),
        "doc_tokens",
        (F.lit(full + patterned) + F.floor(position / window)).alias("sequence_id"),
        F.pmod(position, F.lit(window)).alias("offset"))
    cut = laid.where(F.col("ids_crc32").isNull())
    wanted = cut.groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("start", "length")).alias("parts"))
    sums = (texts.join(wanted, (texts["doc_id"].eqNullSafe(wanted["doc_id"]))
                       & (texts["mark"] == wanted["mark"]))
            .select(texts["doc_id"], texts["mark"], "text", "parts")
            .mapInArrow(lean(lambda batches: recut(batches, path)),
                        "doc_id bigint, mark bigint, start bigint, length bigint, crc bigint")
            .distinct())
    keys = ["doc_id", "mark", "start", "length"]
    mended = cut.alias("c").join(sums.alias("s"), [
        F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]).select(
        "c.doc_id", "c.start", "c.length", F.col("crc").alias("ids_crc32"), "c.doc_tokens",
        "c.sequence_id", "c.offset")
    uncut = laid.where(F.col("ids_crc32").isNotNull()).select(*mended.columns)
    return whole.unionByName(fitted).unionByName(uncut).unionByName(mended)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
