"""Removal of repeated byte strings with a hash-compared suffix sort (operator 5).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller
doc_id, or in the same document). Strings are judged on the input; matches don't cross
documents.

1. Anchors. Of the k-grams of each window of ``LENGTH`` bytes the one with the least hash is
   its anchor (the first such); equal windows have equal anchors, at equal offsets. The
   consecutive windows that have one anchor form a region, in which no two are equal. Only (anchor, region hash, document, start, windows)
   travel, packed as arrays, to the partition of the anchor; a region that the same block has
   already had is settled in the block, so a block sends each region once.
2. There, regions that equal an earlier one are covered whole. If an anchor has several
   different regions, the first of each kind is picked for comparison by content.
3. Suffix sort. The picked regions' bytes meet by anchor. All their window starts are sorted
   as suffixes (up to ``LENGTH`` bytes) by mergesort, inside groups of equal anchor and
   offset. A comparison finds the common extension by binary search over prefix polynomial
   hashes (modulo 2**64, random odd base), then looks at the next byte. Neighbours that agree
   on ``LENGTH`` bytes are verified byte by byte; a class's first member stays, the others are
   covered.
   An anchor with more than ``HOT`` picked regions is not gathered in one task: its windows
   are thinned to distinct ones in each partition, and dealt by their own hash.
4. Covered windows meet their documents, which are cut.

Texts cross the network zstd-compressed, twice; steps 1 to 3 move a small part of them.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows that
share a doc_id, or have none, are ordered by (doc_id, nulls last, text) and judged as documents
of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, mix, partitions, small_batches, stage, text_bytes
from .words import powers

LENGTH = 100
GRAM = 40
HOT = 1024
#: Odd base of the prefix hashes, and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: Windows of one span of covered windows at most; longer ones are cut.
RUN = 60_000
#: Suffixes sorted at once.
SUFFIXES = 1 << 18
BLOCK = 2 << 20
#: Windows hashed at once.
SLICE = 1 << 19

REGION, COVER, PICK, TEXT, CONTENT = range(5)
FIELDS = ("doc", "start", "count", "key", "mark", "body")
PACKED = "part int, kind int, " + ", ".join(f"{f} binary" for f in FIELDS)


class PrefixHash:
    """Polynomial hashes of all substrings of a byte array, from its prefix hashes."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)),
                  out=self.total[1:])
        self.back = powers(INVERSE, len(raw) + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.total[start + length] - self.total[start]) * self.back[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes agree from a and b on, up to ``most`` (binary search)."""
        low = np.where(self.of(a, most) == self.of(b, most), most, 0)
        high = np.full(len(a), most)  # the answer is in [low, high), or low = most
        while True:
            live = np.flatnonzero(high - low > 1)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            same = self.of(a[live], middle) == self.of(b[live], middle)
            low[live] = np.where(same, middle, low[live])
            high[live] = np.where(same, high[live], middle)

    def less(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Whether suffix a is smaller than suffix b, by their first ``most`` bytes."""
        common = self.extension(a, b, most)
        at = np.minimum(common, most - 1)
        return (common < most) & (self.raw[a + at] < self.raw[b + at])


def suffix_mergesort(text: PrefixHash, suffixes: np.ndarray, groups: np.ndarray,
                     most: int = LENGTH) -> np.ndarray:
    """Order of ``suffixes`` inside each run of equal ``groups``: a stable bottom-up mergesort.

    All merges of a level are done together: each suffix of a left run finds its place in the
    right run by binary search; the right run's suffixes take the places left.
    """
    n = len(suffixes)
    order = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else order
    sizes = np.diff(np.append(starts, n))
    width = 1
    while len(sizes) and width < sizes.max():
        big = sizes > width
        starts, sizes = starts[big], sizes[big]
        # pairs of runs: [begin, middle) and [middle, end)
        pairs = -(-sizes // (2 * width))
        begin = np.repeat(starts, pairs) + 2 * width * (
            np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs))
        limit = np.repeat(starts + sizes, pairs)
        middle, end = np.minimum(begin + width, limit), np.minimum(begin + 2 * width, limit)
        both = end > middle
        begin, middle, end = begin[both], middle[both], end[both]
        left = middle - begin
        pair = np.repeat(np.arange(len(begin)), left)
        at = begin[pair] + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
        mine = suffixes[order[at]]
        low, high = middle[pair], end[pair]
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            probe = (low[live] + high[live]) // 2
            smaller = text.less(suffixes[order[probe]], mine[live], most)
            low[live] = np.where(smaller, probe + 1, low[live])
            high[live] = np.where(smaller, high[live], probe)
        place = at + low - middle[pair]
        new = order.copy()
        taken = np.zeros(n, bool)
        taken[place] = True
        new[place] = order[at]
        right = end - middle
        which = np.repeat(np.arange(len(begin)), right)
        theirs = middle[which] + np.arange(right.sum()) - np.repeat(
            np.cumsum(right) - right, right)
        span = end - begin
        inside = np.repeat(begin, span) + np.arange(span.sum()) - np.repeat(
            np.cumsum(span) - span, span)
        new[inside[~taken[inside]]] = order[theirs]
        order = new
        width *= 2
    return order


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def regions(raw: np.ndarray, offsets: np.ndarray):
    """(first window, windows, anchor hash, region hash) of all regions of a block.

    The block is worked on in slices of windows, so a long text takes no more memory than a
    short one; a region that a slice's end cuts is two regions, which changes no result.
    """
    parts = [slice_regions(raw, offsets, at) for at in range(
        0, max(1, len(raw) - LENGTH + 1), SLICE)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def slice_regions(raw: np.ndarray, offsets: np.ndarray, at: int):
    """Regions of the windows that start in [at, at + SLICE)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    piece = raw[at:at + SLICE + LENGTH - 1]
    n = len(piece) - LENGTH + 1
    low = np.maximum(offsets[:-1] - at, 0)
    high = np.minimum(offsets[1:] - LENGTH + 1 - at, n)
    live = low < high
    if not live.any():
        return none[0], none[0], none[1], none[1]
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, low[live], 1)
    np.add.at(inside, high[live], -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    text = PrefixHash(piece)
    grams = mix(text.of(np.arange(len(piece) - GRAM + 1), GRAM))
    anchor = sliding_minimum(grams, LENGTH - GRAM + 1)
    passed = anchor == grams[:len(anchor)]  # the next window has left its anchor's place
    del grams
    value = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = ((value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1)
               | passed[window[:-1]])
    new |= np.isin(window, low[live])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    start = window[head]
    mark = mix(text.of(start, count + LENGTH - 1) ^ count.astype(np.uint64))
    return start + at, count, value[head], mark


def deal(key: np.ndarray, parts: int):
    part = (mix(key.astype(np.int64).view(np.uint64)) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def packed(kind: int, by: str, parts: int, bodies=None, **columns: np.ndarray) -> list[dict]:
    """Rows for each part, with the arrays ``columns`` dealt by one of them."""
    order, at = deal(columns[by].view(np.int64), parts)
    rows = []
    for p in np.flatnonzero(np.diff(at)):
        pick = order[at[p]:at[p + 1]]
        row = {"part": int(p), "kind": kind} | {n: c[pick].tobytes() for n, c in columns.items()}
        if bodies is not None:
            row["body"] = bodies(pick)
        rows.append(row)
    return rows


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r["part"] for r in rows], pa.int32()),
         pa.array([r["kind"] for r in rows], pa.int32()),
         *[pa.array([r.get(f) for r in rows], pa.binary()) for f in FIELDS]],
        ["part", "kind", *FIELDS])


def covers(doc: np.ndarray, start: np.ndarray, count: np.ndarray, parts: int) -> list[dict]:
    return packed(COVER, "doc", parts, doc=doc, start=start.astype(np.int32),
                  count=count.astype(np.uint16))


def find_regions(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Regions dealt by anchor; in a block, those that equal an earlier one are settled."""
    for table in blocks(batches, "text", BLOCK):
        raw, offsets = text_bytes(table.column("text"))
        ids = np.asarray(table.column("doc_id"))
        start, count, key, mark = regions(raw, offsets)
        if not len(start):
            continue
        row = np.searchsorted(offsets, start, side="right") - 1
        doc, start = ids[row], start - offsets[row]
        order = np.lexsort((start, doc, mark, key))
        again = np.zeros(len(order), bool)
        again[1:] = ((key[order[1:]] == key[order[:-1]])
                     & (mark[order[1:]] == mark[order[:-1]]))
        later, first = order[again], np.sort(order[~again])
        rows = packed(REGION, "key", parts, doc=doc[first], start=start[first].astype(np.int32),
                      count=count[first].astype(np.uint16), key=key[first], mark=mark[first])
        yield batch_of(rows + covers(doc[later], start[later], count[later], parts))


def gathered(batches: Iterator[pa.RecordBatch], kind: int, keep: list[dict] | None = None):
    """The arrays of all rows of ``kind``; other rows are appended to ``keep``."""
    types = {"doc": np.int64, "start": np.int32, "count": np.uint16, "key": np.uint64,
             "mark": np.uint64}
    held: dict[str, list] = {n: [] for n in types}
    bodies: list[bytes] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == kind:
                for n, t in types.items():
                    held[n].append(np.frombuffer(row[n] or b"", t))
                bodies.append(row["body"])
            elif keep is not None:
                keep.append(row)
    out = {n: np.concatenate(held[n]) if held[n] else np.zeros(0, t) for n, t in types.items()}
    out["start"], out["count"] = out["start"].astype(np.int64), out["count"].astype(np.int64)
    return out, bodies


def compare_regions(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Cover regions that equal an earlier one; pick those to be compared by content."""
    rest: list[dict] = []
    got, _ = gathered(batches, REGION, rest)
    if rest:
        yield batch_of(rest)
    if not len(got["doc"]):
        return
    order = np.lexsort((got["start"], got["doc"], got["mark"], got["key"]))
    doc, start, count, key, mark = (got[n][order] for n in
                                    ("doc", "start", "count", "key", "mark"))
    del got
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_mark = new_key | np.concatenate([[True], mark[1:] != mark[:-1]])
    yield batch_of(covers(doc[~new_mark], start[~new_mark], count[~new_mark], parts))
    doc, start, count, key, head = (x[new_mark] for x in (doc, start, count, key, new_key))
    kinds = np.diff(np.append(np.flatnonzero(head), len(head)))
    kinds = np.repeat(kinds, kinds)
    pick = kinds > 1
    hot = (kinds > HOT).astype(np.uint64)
    yield batch_of(packed(PICK, "doc", parts, doc=doc[pick],
                          start=start[pick].astype(np.int32),
                          count=count[pick].astype(np.uint16), key=key[pick], mark=hot[pick]))


def squeeze(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Texts dealt by document, those of a block and part compressed together."""
    packer = zstandard.ZstdCompressor(level=1)
    for table in blocks(batches, "text", BLOCK):
        raw, offsets = text_bytes(table.column("text"))
        ids = np.ascontiguousarray(np.asarray(table.column("doc_id")))
        sizes = np.diff(offsets)

        def body(pick: np.ndarray, raw=raw, offsets=offsets) -> bytes:
            return packer.compress(b"".join(
                raw[offsets[k]:offsets[k + 1]].tobytes() for k in pick))

        # the byte length of a text stands in the place of an anchor
        yield batch_of(packed(TEXT, "doc", parts, body, doc=ids, key=sizes.astype(np.uint64)))


def unsqueezed(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """(doc_id, text) of packed texts, one pack in memory at a time."""
    unpacker = zstandard.ZstdDecompressor()
    for row in rows:
        ids = np.frombuffer(row["doc"], np.int64)
        ends = np.cumsum(np.frombuffer(row["key"], np.uint64).astype(np.int64))
        data = unpacker.decompress(row["body"], max_output_size=int(ends[-1]) + 1)
        at = 0
        for doc, end in zip(ids.tolist(), ends.tolist(), strict=True):
            yield doc, data[at:end]
            at = end


def runs_of(doc: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where the rows of each document lie in a sorted array."""
    ids, first = np.unique(doc, return_index=True)
    last = [*first[1:].tolist(), len(doc)] if len(doc) else []
    return {d: (a, b) for d, a, b in zip(ids.tolist(), first.tolist(), last, strict=True)}


def cut_out(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The bytes of picked regions, dealt by anchor; windows of hot anchors one by one."""
    texts: list[dict] = []
    got, _ = gathered(batches, PICK, texts)
    order = np.lexsort((got["start"], got["doc"]))
    doc, start, count, key, hot = (got[n][order] for n in ("doc", "start", "count", "key", "mark"))
    if not len(doc):
        return
    pieces: list[bytes] = [b""] * len(doc)
    where = runs_of(doc)
    for d, text in unsqueezed(texts):
        a, b = where.get(d, (0, 0))
        for k in range(a, b):
            pieces[k] = text[start[k]:start[k] + count[k] + LENGTH - 1]
    cold = np.flatnonzero(hot == 0)
    for at in range(0, len(cold), 50_000):
        some = cold[at:at + 50_000]
        yield batch_of(packed(
            CONTENT, "key", parts, lambda pick, some=some: b"".join(pieces[k] for k in some[pick]),
            doc=doc[some], start=start[some].astype(np.int32),
            count=count[some].astype(np.uint16), key=key[some]))
    warm = np.flatnonzero(hot)
    if not len(warm):
        return
    raw = np.frombuffer(b"".join(pieces[k] for k in warm), np.uint8)
    sizes = count[warm] + LENGTH - 1
    base = np.repeat(np.cumsum(sizes) - sizes, count[warm])
    step = np.arange(count[warm].sum()) - np.repeat(
        np.cumsum(count[warm]) - count[warm], count[warm])
    window, own = base + step, np.repeat(warm, count[warm])
    name = mix(PrefixHash(raw).of(window, LENGTH))
    order = np.lexsort((start[own] + step, doc[own], name))
    again = np.concatenate([[False], name[order[1:]] == name[order[:-1]]])
    later, kept = order[again], order[~again]
    yield batch_of(covers(doc[own[later]], (start[own] + step)[later],
                          np.ones(len(later), np.int64), parts))
    yield batch_of(packed(
        CONTENT, "key", parts,
        lambda pick: raw[window[kept[pick]][:, None] + np.arange(LENGTH)].tobytes(),
        doc=doc[own[kept]], start=(start[own] + step)[kept].astype(np.int32),
        count=np.ones(len(kept), np.uint16), key=name[kept]))


def sorted_covers(doc, start, count, key, pieces: list[bytes]):
    """Window starts (doc, start) that also start earlier, among regions in key order."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    text = PrefixHash(raw)
    sizes = count + LENGTH - 1
    base = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(doc)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    window = base[own] + step
    # where the anchor stands in each window: equal windows have it at the same place
    grams = mix(text.of(np.arange(len(raw) - GRAM + 1), GRAM))
    place = np.flatnonzero(grams == np.repeat(key, sizes)[:len(grams)])
    after = np.append(place, len(raw))[np.searchsorted(place, window)]
    offset = np.minimum(after - window, LENGTH)
    del grams
    order = np.lexsort((start[own] + step, doc[own], offset, own_group(key)[own]))
    window, own, step, offset = window[order], own[order], step[order], offset[order]
    group = np.cumsum(np.concatenate([[0], (key[own[1:]] != key[own[:-1]])
                                      | (offset[1:] != offset[:-1])]))
    sort = suffix_mergesort(text, window, group)
    a, b = window[sort[:-1]], window[sort[1:]]
    same = (group[sort[1:]] == group[sort[:-1]]) & (text.of(a, LENGTH) == text.of(b, LENGTH))
    for at in range(0, len(same), 1 << 16):  # verify hash matches on the bytes
        k = at + np.flatnonzero(same[at:at + (1 << 16)])
        byte = np.arange(LENGTH)
        same[k] = (raw[a[k][:, None] + byte] == raw[b[k][:, None] + byte]).all(1)
    hit = sort[1:][same]
    return doc[own[hit]], start[own[hit]] + step[hit]


def own_group(key: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else key


def sort_contents(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Covered windows among the picked regions of a partition."""
    rest: list[dict] = []
    got, bodies = gathered(batches, CONTENT, rest)
    if rest:
        yield batch_of(rest)
    if not len(got["doc"]):
        return
    raw, sizes = b"".join(bodies), got["count"] + LENGTH - 1
    del bodies
    at = np.cumsum(sizes) - sizes
    order = np.argsort(got["key"], kind="stable")
    key = got["key"][order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
    total = np.concatenate([[0], np.cumsum(got["count"][order])])
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(total[edges], total[edges[a]] + SUFFIXES)) - 1)
        some = order[edges[a]:edges[b]]
        doc, start = sorted_covers(
            got["doc"][some], got["start"][some], got["count"][some], got["key"][some],
            [raw[at[k]:at[k] + sizes[k]] for k in some])
        if len(doc):
            line = np.lexsort((start, doc))
            doc, start = doc[line], start[line]
            head = np.flatnonzero(np.concatenate(
                [[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
            count = np.diff(np.append(head, len(doc)))
            reps = -(-count // RUN)
            step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            head = np.repeat(head, reps) + RUN * step
            count = np.minimum(np.repeat(count, reps) - RUN * step, RUN)
            yield batch_of(covers(doc[head], start[head], count, parts))
        a = b


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without their covered bytes: doc_id, n_bytes, removed spans, bytes kept."""
    texts: list[dict] = []
    got, _ = gathered(batches, COVER, texts)
    order = np.lexsort((got["start"], got["doc"]))
    doc, start, count = (got[n][order] for n in ("doc", "start", "count"))
    where = runs_of(doc)
    rows, held = [], 0
    for d, text in unsqueezed(texts):
        a, b = where.get(d, (0, 0))
        spans: list[list[int]] = []
        for s, c in zip(start[a:b].tolist(), count[a:b].tolist(), strict=True):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], s + c + LENGTH - 1)
            else:
                spans.append([s, s + c + LENGTH - 1])
        kept, at = [], 0
        for s, e in spans:
            kept.append(text[at:s])
            at = e
        kept.append(text[at:])
        rows.append((d, len(text), spans, b"".join(kept)))
        held += len(text)
        if held > BLOCK:
            yield cut_batch(rows)
            rows, held = [], 0
    yield cut_batch(rows)


def cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    docs, sizes, spans, kept = zip(*rows) if rows else [()] * 4
    pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()),
         pa.array([[{"start": s, "stop": e} for s, e in x] for x in spans], pa.list_(pair)),
         pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes [start, stop)), kept (binary) of ``documents``
    (doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = source.select("doc_id").groupBy("doc_id").count().where(
        (F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty()
    names = None
    if not plain:
        # ids of a sorted table's rows grow with the order of the rows
        names = stage(source.orderBy(F.col("doc_id").asc_nulls_last(), "text").select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
        source = names.select(F.col("row").alias("doc_id"), "text")
    texts = source.mapInArrow(lean(lambda b: squeeze(b, parts)), PACKED)

    def meet(rows: DataFrame, function, schema: str = PACKED) -> DataFrame:
        return rows.repartitionById(parts, F.col("part")).mapInArrow(lean(function), schema)

    found = source.mapInArrow(lean(lambda b: find_regions(b, parts)), PACKED)
    settled = stage(meet(found, lambda b: compare_regions(b, parts)), "regions")
    contents = meet(settled.where(F.col("kind") == PICK).unionByName(texts),
                    lambda b: cut_out(b, parts))
    more = meet(contents, lambda b: sort_contents(b, parts))
    out = meet(settled.where(F.col("kind") == COVER).unionByName(more).unionByName(texts),
               cut_texts, "doc_id bigint, n_bytes bigint, "
               "spans array<struct<start: bigint, stop: bigint>>, kept binary")
    if names is None:
        return out
    return out.join(names.select(F.col("row"), F.col("doc_id").alias("name")),
                    out["doc_id"] == F.col("row")).select(
        F.col("name").alias("doc_id"), "n_bytes", "spans", "kept")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without bytes of repeated 100-byte strings."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"),
                          lambda t, s: t + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
