"""Benchmark decontamination with an FM-index per shard (operator 2).

A shard is a block of whole documents inside a task, so nothing is shuffled. Test phrases are
windows of ``window`` consecutive benchmark words (an item with fewer words is one window).

1. Words become ids of the test vocabulary. A word that no phrase holds can't lie in an
   occurrence, so it only separates; a stretch between separators that is shorter than the
   shortest phrase can't hold one either and isn't indexed. Both leave the result as it is.
2. The suffix array of the shard's stretches is built by prefix doubling (each separator is
   smaller than all words and differs from the others, so comparisons end there). Its BWT
   goes into a wavelet matrix, which gives rank(symbol, position) in log2(alphabet) steps.
3. All phrases are searched backward at once; each step narrows a phrase's row interval by
   two ranks.
4. Occurrences are located by walking back (LF steps) to the nearest sampled suffix position.
5. Overlapping and touching spans merge into removal spans per document.

The test set is broadcast in packs of ``PACK_WORDS`` words at most, so a large benchmark takes
several passes, each with a bounded index of phrases.

Defined results: a null or empty text has no words and no hits; a null or empty benchmark text
has no phrases; items that share an id count once; repeated documents are judged alike; an
empty benchmark hits nothing; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, small_batches, stage, text_bytes
from .words import byte_class, lowered, word_bounds, word_hashes

WINDOW = 10
SAMPLE = 16
#: Benchmark words searched in one pass; bounds what is broadcast (8 bytes a word, times the
#: window for the phrases).
PACK_WORDS = 2_000_000

#: Word bytes: a-z, 0-9 and all bytes of characters beyond ASCII (after lower-casing).
WORD = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


class WaveletMatrix:
    """Rank over a sequence of symbols: one bit vector with running counts per level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            count = np.zeros(len(row) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(row) - int(count[-1]))
            row = np.concatenate([row[~bit], row[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``upto`` (both arrays)."""
        low, high = np.zeros_like(upto), upto
        for k, ones in enumerate(self.ones):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            low_one, high_one = ones[low], ones[high]
            low = np.where(bit, self.zeros[k] + low_one, low - low_one)
            high = np.where(bit, self.zeros[k] + high_one, high - high_one)
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; zeros separate and differ."""
    n = len(text)
    zero = text == 0
    separators = int(zero.sum())
    rank = text.astype(np.int64) + separators
    rank[zero] = np.arange(separators)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        changed = np.zeros(n, np.int64)
        changed[1:] = ordered[1:] != ordered[:-1]
        if step > 1:
            second = after[order]  # noqa: F821  (set in the first round)
            changed[1:] |= second[1:] != second[:-1]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(changed)
        rank = dense
        if int(rank[order[-1]]) == n - 1 if n else True:
            return order
        after = np.full(n, -1, np.int64)
        after[:n - step] = rank[step:]
        order = np.argsort(rank * (n + 1) + after + 1, kind="stable")
        step *= 2


class FMIndex:
    """Backward search over one shard; symbol 0 separates stretches."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_array(text)
        self.text_length = len(text)
        self.bwt = text[order - 1]
        self.tree = WaveletMatrix(self.bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # the first suffix of each stretch too: no walk back then crosses a separator
        self.sampled = (order % sample == 0) | (self.bwt == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray):
        """Row intervals of all phrases (one per row, left-aligned)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.text_length, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - k]
            start = self.before[symbol]
            low[live] = start + self.tree.rank(symbol, low[live])
            high[live] = start + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in ``rows``."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            at = rows[live]
            symbol = self.bwt[at]
            rows[live] = self.before[symbol] + self.tree.rank(symbol, at)
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.sample_rank[rows]] + steps


def phrases_of(items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """Vocabulary and phrases of benchmark items [(id, text)], as arrays for a broadcast."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    column = pa.array([t or "" for _, t in items], pa.large_string()).cast(pa.string())
    raw, offsets = text_bytes(column)
    raw = lowered(raw)
    begin, end, first = word_bounds(raw, offsets, WORD)
    hashes = word_hashes(raw, begin, end)
    vocabulary = np.unique(hashes)
    ids = np.searchsorted(vocabulary, hashes) + 1
    rows: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    for k, (name, _) in enumerate(items):
        own = ids[first[k]:first[k + 1]]
        if not len(own):
            continue
        size = min(window, len(own))
        got = np.zeros((len(own) - size + 1, window), np.int64)
        got[:, :size] = np.lib.stride_tricks.sliding_window_view(own, size)
        rows.append(got)
        owner.append(np.full(len(got), number[name]))
        lengths.append(np.full(len(got), size))
    if not rows:
        return {"names": names, "vocabulary": vocabulary,
                "phrases": np.zeros((0, window), np.int64), "lengths": np.zeros(0, np.int64),
                "owners": np.zeros(0, np.int64), "of": np.zeros(0, np.int64)}
    every = np.concatenate(rows)
    phrases, which = np.unique(every, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.lexsort((np.concatenate(owner), which))
    pairs = np.unique(np.stack([which[order], np.concatenate(owner)[order]], 1), axis=0)
    size = np.zeros(len(phrases), np.int64)
    size[which] = np.concatenate(lengths)
    return {"names": names, "vocabulary": vocabulary, "phrases": phrases, "lengths": size,
            "of": np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)),
            "owners": pairs[:, 1]}


def occurrences(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray,
                test: dict):
    """(word index, length, phrase) of every occurrence of a test phrase in a shard."""
    none = np.zeros(0, np.int64)
    if not len(test["lengths"]) or not len(begin):
        return none, none, none
    vocabulary = test["vocabulary"]
    hashes = word_hashes(raw, begin, end)
    slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[slot] == hashes
    # stretches of known words inside one document
    edge = np.zeros(len(known) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    stops = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = stops - starts >= test["lengths"].min()
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return none, none, none
    sizes = stops - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes) + np.repeat(starts, sizes)
    text = np.zeros(at[-1], np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    text[inner] = slot[place[inner]] + 1
    index = FMIndex(text, len(vocabulary) + 1)
    low, high = index.search(test["phrases"], test["lengths"])
    count = high - low
    found = np.flatnonzero(count)
    reps = count[found]
    rows = np.repeat(low[found], reps) + (
        np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
    phrase = np.repeat(found, reps)
    return place[index.locate(rows)], test["lengths"][phrase], phrase


def merged_spans(start: np.ndarray, stop: np.ndarray):
    """Union of the spans [start, stop), overlapping or touching ones merged."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], stop[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stop) - 1]])]


def earlier(table: pa.Table, first: np.ndarray):
    """Spans (as word indexes of the block) and (document, item) pairs of earlier passes."""
    spans, items = table.column("spans").combine_chunks(), table.column("items").combine_chunks()
    docs = np.arange(table.num_rows)
    doc = np.repeat(docs, np.diff(np.asarray(spans.offsets)))
    flat = spans.flatten()
    start, stop = (np.asarray(flat.field(k)) + first[doc] for k in (0, 1))
    return start, stop, np.repeat(docs, np.diff(np.asarray(items.offsets))), items.flatten()


def scan(batches: Iterator[pa.RecordBatch], test: dict, more: bool, text: bool,
         cut: bool) -> Iterator[pa.RecordBatch]:
    """Add to each row n_words, n_hit, items and spans, to which earlier passes (``more``)
    have contributed; keep the text if ``text``, without the spans if ``cut``."""
    names = pa.array(test["names"], pa.string())
    for table in blocks(batches, "text"):
        source, offsets = text_bytes(table.column("text"))
        raw = lowered(source)
        begin, end, first = word_bounds(raw, offsets, WORD)
        word, size, phrase = occurrences(raw, begin, end, first, test)
        place = np.searchsorted(first, word, side="right") - 1
        docs = len(offsets) - 1
        reps = test["of"][phrase + 1] - test["of"][phrase]
        own = (np.repeat(test["of"][phrase], reps) + np.arange(reps.sum())
               - np.repeat(np.cumsum(reps) - reps, reps))
        pair = np.unique(np.repeat(place, reps) * (len(names) + 1) + test["owners"][own])
        pair_doc, item = pair // (len(names) + 1), names.take(pa.array(pair % (len(names) + 1)))
        start, stop = word, word + size
        if more:
            was_start, was_stop, was_doc, was_item = earlier(table, first)
            start, stop = np.concatenate([was_start, start]), np.concatenate([was_stop, stop])
            item = pa.concat_arrays([was_item, item])
            pair_doc = np.concatenate([was_doc, pair_doc])
            order = np.argsort(pair_doc, kind="stable")
            pair_doc, item = pair_doc[order], item.take(pa.array(order))
        start, stop = merged_spans(start, stop)
        start, stop = split_at(start, stop, first)
        doc = np.searchsorted(first, start, side="right") - 1
        at = np.arange(docs + 1)
        columns = {n: table.column(n) for n in table.column_names
                   if n not in ("text", "n_words", "n_hit", "items", "spans")}
        if text:
            columns["text"] = table.column("text") if not cut else without(
                table.column("text"), doc, begin[start] - offsets[doc],
                (end[stop - 1] if len(stop) else stop) - offsets[doc])
        columns |= {
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_hit": pa.array(np.bincount(doc, weights=stop - start, minlength=docs)
                              .astype(np.int64)),
            "items": pa.ListArray.from_arrays(
                pa.array(np.searchsorted(pair_doc, at), pa.int32()), item),
            "spans": pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, at), pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(start - first[doc], pa.int64()),
                     pa.array(stop - first[doc], pa.int64())], ["start", "stop"]))}
        yield from pa.table(columns).to_batches()


def split_at(start: np.ndarray, stop: np.ndarray, first: np.ndarray):
    """Cut spans that touch across two documents; ``first`` has the documents' first words."""
    inner = first[1:-1]
    k = np.searchsorted(stop, inner, side="right")
    live = k < len(start)
    inner, k = inner[live], k[live]
    inner = np.unique(inner[start[k] < inner])
    start = np.sort(np.concatenate([start, inner]))
    return start, np.sort(np.concatenate([stop, inner]))


def without(column: pa.ChunkedArray, doc: np.ndarray, left: np.ndarray,
            right: np.ndarray) -> pa.Array:
    """The texts without the byte spans [left, right)."""
    texts = column.to_pylist()
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in np.unique(doc):
        data, kept, at = texts[d].encode(), [], 0
        for k in range(edges[d], edges[d + 1]):
            kept.append(data[at:left[k]])
            at = right[k]
        texts[d] = b"".join([*kept, data[at:]]).decode()
    return pa.array(texts, pa.string())


def packs(benchmark: DataFrame, most: int):
    """Benchmark items in packs of about ``most`` words (a word and its gap take two
    characters at least), which the driver reads one after another."""
    rows = benchmark.where(F.length("text") > 0).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    held, size = [], 0
    for name, body in rows.toLocalIterator():
        held.append((name, body))
        size += len(body) // 2
        if size >= most:
            yield held
            held, size = [], 0
    yield held


def find_contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str],
                       window: int = WINDOW, cut: bool = False,
                       pack_words: int = PACK_WORDS) -> DataFrame:
    """``keep`` columns of ``documents`` (and the text without the hit words if ``cut``) with
    n_words, n_hit, items (sorted distinct ids) and spans (words [start, stop) of merged
    occurrences). Columns of these four names in ``keep`` are replaced.

    A benchmark of more than ``pack_words`` words is searched in several passes, with a
    written table between two passes.
    """
    spark = documents.sparkSession
    small_batches(spark)
    ours = ("n_words", "n_hit", "items", "spans")
    names = [*dict.fromkeys(c for c in keep if c not in (*ours, "text")), "text"]
    found = documents.select(*[F.col(f"`{c}`") for c in names])
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema
                      if f.name != "text")
    added = ("n_words bigint, n_hit bigint, items array<string>, "
             "spans array<struct<start: bigint, stop: bigint>>")
    tests = packs(benchmark, pack_words)
    test, more = next(tests), False
    while test is not None:
        after = next(tests, None)
        shared = spark.sparkContext.broadcast(phrases_of(test, window))
        last, text = after is None, after is not None or cut
        schema = ", ".join(x for x in (plain, "text string" * text, added) if x)
        found = found.mapInArrow(
            lean(lambda b, t=shared, m=more, x=text, c=last and cut: scan(b, t.value, m, x, c)),
            schema)
        if not last:
            found = stage(found, "decontaminate")
        test, more = after, True
    return found.withColumn("items", F.array_sort(F.array_distinct("items")))


def removal_text(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` (all columns) without the words of benchmark phrases."""
    names = documents.columns
    found = find_contamination(documents, benchmark, names, cut=True)
    return found.select(*[
        F.length("text").cast(documents.schema["n_chars"].dataType).alias("n_chars")
        if c == "n_chars" else F.col(f"`{c}`") for c in names])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document, over whole texts."""
    found = find_contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b
        WHERE len(w) > 0)
), s AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), h AS (
  SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p ON s.n = p.n AND s.x = p.x
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
