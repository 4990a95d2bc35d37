"""Trie of conversation prefixes from sorted LCPs and sparse tables (operator 11).

A conversation is a sequence of turns; a turn is its 128-bit digest of role and text, so texts
are read once and never shuffled. Sequences are sorted (range partitions, ordered inside), and a
partition is cut into segments of bounded size, each one row of packed arrays.

Inside a segment, for the longest common prefixes (LCP) of sorted neighbours:

1. a sparse table answers the least LCP of any range;
2. every candidate prefix (position i, depth d with LCP[i] < d <= length) binary-searches its
   extents on that table: to the right as long as the least LCP is at least d, and its parent to
   the left in the same way. All candidates search independently, as array operations; no stack;
3. members are the extent's length, the smallest member a range minimum, and a subtree is a run of
   candidates in (i, d) order, so its sums are differences of running totals.

A prefix that holds a segment's first or last conversation may go on in the neighbour. Such
open prefixes (one for each turn of two conversations of a segment) are merged by a digest of the
prefix with partial sums. The merged values go back to their segments, which then add up their
candidates, an open one being counted in the segment where it begins.

A very common first turn or conversation is therefore cut by the range partitions like any other
rows, and no task holds more than a segment and the open prefixes of one.

Defined results: a null role or text is empty; turns are ordered by turn, null first, then by
digest, so equal turn numbers have one order; repeated rows are turns each; rows without a
conversation id belong to none and are left out; conversations without turns are members of the
root only; an empty table has no root. Digests of a conversation's turns (28 bytes each) have to
fit into one row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, partitions, ship, stage

#: A digest of a turn, in bytes.
WIDTH = 16
#: Most turns and conversations of a segment (one conversation at least).
SEGMENT_TURNS = 1 << 17
SEGMENT_ROWS = 1 << 16
#: Ids in one row of the table of ends.
CHUNK = 1 << 14

SEGMENT = ("part int, block int, ids binary, lengths binary, keys binary, words binary")
OPEN = ("prefix binary, parent binary, part int, block int, depth bigint, n bigint, "
        "conv_id bigint, children bigint, words bigint, ends array<array<bigint>>")
NODE = ("prefix binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint, ends array<bigint>")


# ---------------------------------------------------------------- sequences of turns

def turn_digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, row struct<t, h, w>): order, digest and number of words of each turn."""
    said = F.coalesce(F.col(text), F.lit(""))
    by = F.coalesce(F.col(role), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256)
    return conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(
            F.col(turn).alias("t"), F.substring(digest, 1, 2 * WIDTH).alias("h"),
            F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
        .alias("row"))


def in_order() -> Column:
    """The turns of a group of rows, in order."""
    return F.transform(F.sort_array(F.collect_list("row")),
                       lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("turns")


def sequences(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, turns array<struct<h, w>>): each conversation as it is."""
    return turn_digests(conversations, **columns).groupBy("conv_id").agg(in_order())


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4, **columns: str) -> DataFrame:
    """Sequences that begin with up to ``most`` - 1 turns of another conversation.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation c - c %
    ``every`` and goes on with its own turns after its first h. Conversations of one base share
    a partition, so turns are shuffled once and the base's come from a window of at most
    2 * ``every`` conversations.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    own = (turn_digests(conversations, **columns).withColumn("base", base).repartition("base")
           .groupBy("base", "conv_id").agg(in_order()))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most - 1))).over(
        Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    after = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.withColumn("head", head).select(
        "conv_id", F.concat(F.coalesce(F.slice("head", 1, h), F.slice("turns", 1, 0)), after)
        .alias("turns"))


# ---------------------------------------------------------------- segments

def pack_segments(batches: Iterator[pa.RecordBatch], most_turns: int,
                  most_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, key, words) as segments of bounded size."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    block = turns = 0
    ids: list[int] = []
    keys: list[bytes] = []
    words: list[np.ndarray] = []

    def segment() -> pa.RecordBatch:
        sizes = np.array([len(k) // WIDTH for k in keys], np.int64)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
            "ids": [np.array(ids, np.int64).tobytes()], "lengths": [sizes.tobytes()],
            "keys": [b"".join(keys)],
            "words": [np.concatenate([np.zeros(0, np.int64), *words]).tobytes()]})

    for batch in batches:
        column = batch.column(2)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.asarray(column.value_lengths()))
        for k, (conv, key) in enumerate(zip(batch.column(0).to_pylist(),
                                            batch.column(1).to_pylist(), strict=True)):
            n = len(key) // WIDTH
            if ids and (turns + n > most_turns or len(ids) >= most_rows):
                yield segment()
                ids, keys, words, turns = [], [], [], 0
                block += 1
            ids.append(conv)
            keys.append(key)
            words.append(flat[ends[k] - n:ends[k]].astype(np.int64))
            turns += n
    if ids:
        yield segment()


def sorted_segments(seqs: DataFrame, most_turns: int, most_rows: int) -> DataFrame:
    """All sequences in order, a row for each segment; (part, block) orders the segments."""
    spark = seqs.sparkSession
    keyed = seqs.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["h"]), "")).alias("key"),
        F.transform("turns", lambda t: t["w"]).alias("words"))
    ordered = keyed.repartitionByRange(partitions(spark), "key", "conv_id").sortWithinPartitions(
        "key", "conv_id")
    return stage(ordered.mapInArrow(lean(
        lambda batches: pack_segments(batches, most_turns, most_rows)), SEGMENT), "segments")


# ---------------------------------------------------------------- one segment

def adjacent_lcp(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common leading turns of each sequence and the one before it; -1 for the first."""
    n = len(lengths)
    out = np.full(n, -1, np.int64)
    if n < 2:
        return out
    starts = np.cumsum(lengths) - lengths
    common = np.minimum(lengths[1:], lengths[:-1])
    out[1:] = common
    at = np.flatnonzero(common)
    if len(at):
        first = np.cumsum(common[at]) - common[at]
        step = np.arange(int(common[at].sum())) - np.repeat(first, common[at])
        here = np.repeat(starts[at + 1], common[at]) + step
        before = np.repeat(starts[at], common[at]) + step
        differ = (keys[here] != keys[before]).any(1)
        until = np.where(differ, step, np.repeat(common[at], common[at]))
        out[at + 1] = np.minimum.reduceat(until, first)
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the least of each 2**k neighbours."""
    levels = [values]
    step = 1
    while 2 * step <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    return levels


def range_minimum(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value of each range [first, last]."""
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        out[rows] = np.minimum(table[k][first[rows]], table[k][last[rows] - (1 << int(k)) + 1])
    return out


def right_extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last position that shares ``depth`` turns with each position."""
    n, at = len(table[0]), at.copy()
    for k in range(len(table) - 1, -1, -1):
        room = at + (1 << k) < n
        go = room & (table[k][np.where(room, at + 1, 0)] >= depth)
        at[go] += 1 << k
    return at


def left_extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first position that shares ``depth`` turns with each position."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        room = at - (1 << k) >= 0
        go = room & (table[k][np.where(room, at - (1 << k) + 1, 0)] >= depth)
        at[go] -= 1 << k
    return at


@dataclass
class Segment:
    """The candidate prefixes of one segment, in (position, depth) order."""

    ids: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray      # (turns, WIDTH) bytes
    at: np.ndarray        # position where the prefix begins
    depth: np.ndarray
    last: np.ndarray      # position where its members end
    parent: np.ndarray    # index of the parent's candidate, -1 for the root
    least: np.ndarray     # smallest member
    words: np.ndarray     # words of its last turn
    open: np.ndarray      # whether it holds the first or last position
    ends: np.ndarray      # how many members, from ``at`` on, have no further turn

    @classmethod
    def of(cls, row: dict) -> Segment:
        ids = np.frombuffer(row["ids"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        keys = np.frombuffer(row["keys"], np.uint8).reshape(-1, WIDTH)
        per_turn = np.frombuffer(row["words"], np.int64)
        n = len(ids)
        lcp = adjacent_lcp(keys, lengths)
        table, smallest = sparse_table(lcp), sparse_table(ids)
        count = lengths - lcp
        first = np.cumsum(count) - count
        at = np.repeat(np.arange(n), count)
        depth = np.arange(len(at)) - np.repeat(first, count) + np.repeat(lcp, count) + 1
        last = right_extents(table, at, depth)
        begin = left_extents(table, at, depth - 1)
        parent = np.where(depth > 0, first[begin] + depth - 1 - lcp[begin] - 1, -1)
        starts = np.cumsum(lengths) - lengths
        words = np.zeros(len(at), np.int64)
        deep = depth > 0
        words[deep] = per_turn[starts[at[deep]] + depth[deep] - 1]
        # equal sequences stand together: those of a run end at the run's first position
        run = np.cumsum((lcp != lengths) | (np.append(-1, lengths[:-1]) != lengths)) - 1
        size = np.bincount(run)
        ends = np.where(depth == lengths[at], size[run[at]], 0)
        return cls(ids, lengths, keys, at, depth, last, parent,
                   range_minimum(smallest, at, last), words, (at == 0) | (last == n - 1), ends)

    def prefixes(self, rows: np.ndarray) -> list[bytes]:
        """A digest of each open prefix; rows of one position stand together, depth ascending."""
        starts = np.cumsum(self.lengths) - self.lengths
        out, position, state, done = [], -1, None, 0
        for r in rows:
            if self.at[r] != position:
                position, state, done = self.at[r], hashlib.sha256(), 0
            begin = starts[position]
            state.update(self.keys[begin + done:begin + self.depth[r]].tobytes())
            done = self.depth[r]
            out.append(state.digest()[:WIDTH])
        return out

    def owners(self) -> tuple[np.ndarray, list[bytes], dict[int, bytes]]:
        """The open candidates and their digests."""
        rows = np.flatnonzero(self.open)
        digests = self.prefixes(rows)
        return rows, digests, dict(zip(rows.tolist(), digests, strict=True))


def open_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a segment knows of its open prefixes: members, closed children, ends."""
    names = [x.split()[0] for x in OPEN.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            s = Segment.of(row)
            rows, digests, by = s.owners()
            inner = (~s.open) & (s.parent >= 0)
            children = np.bincount(s.parent[inner], minlength=len(s.at))
            out = []
            for r, digest in zip(rows.tolist(), digests, strict=True):
                ids = s.ids[s.at[r]:s.at[r] + s.ends[r]].tolist()
                out.append((digest, by.get(int(s.parent[r])), row["part"], row["block"],
                            int(s.depth[r]), int(s.last[r] - s.at[r] + 1), int(s.least[r]),
                            int(children[r]), int(s.words[r]),
                            [ids[k:k + CHUNK] for k in range(0, len(ids), CHUNK)]))
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * 5,
                     pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names)


def segment_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed prefixes with all their values (``prefix`` null), and for each open one what this
    segment adds to its leaves and saved tokens (``prefix`` set)."""
    for batch in batches:
        for row in batch.to_pylist():
            s = Segment.of(row)
            rows, digests, _ = s.owners()
            merged = {m["prefix"]: m for m in row["merged"]}
            known = [merged[d] for d in digests]
            n = s.last - s.at + 1
            conv = s.least.copy()
            children = np.bincount(s.parent[s.parent >= 0], minlength=len(s.at))
            n[rows] = [m["n"] for m in known]
            conv[rows] = [m["conv_id"] for m in known]
            children[rows] = [m["children"] for m in known]
            here = np.ones(len(s.at), bool)
            here[rows] = [m["part"] == row["part"] and m["block"] == row["block"] for m in known]
            saved = np.append(0, np.cumsum(np.where(here, (n - 1) * s.words, 0)))
            leaves = np.append(0, np.cumsum(here & (children == 0)))
            behind = np.append(np.searchsorted(s.at, np.arange(1, len(s.ids))), len(s.at))
            upto = behind[s.last]  # a subtree is a run of candidates
            index = np.arange(len(s.at))
            saved, leaves = saved[upto] - saved[index], leaves[upto] - leaves[index]
            closed = np.flatnonzero(~s.open)
            both = np.concatenate([closed, rows])
            shut = np.arange(len(both)) < len(closed)
            size = np.where(shut, s.ends[both], 0)
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            take = np.repeat(s.at[both] - offsets[:-1], size) + np.arange(offsets[-1])

            def only(values: np.ndarray) -> pa.Array:
                return pa.array(values[both], pa.int64(), mask=~shut)

            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(closed) + digests, pa.binary()), only(conv),
                 pa.array(s.depth[both]), only(conv[s.parent]), only(n), only(children),
                 pa.array(leaves[both]), pa.array(saved[both]),
                 pa.ListArray.from_arrays(offsets, pa.array(s.ids[take]))],
                [x.split()[0] for x in NODE.split(", ")])


# ---------------------------------------------------------------- the whole trie

@dataclass
class Trie:
    """``nodes``: one row per prefix (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends, node). ``ends`` lists, ascending, the members without further
    turns; where it is null they are in ``open_ends`` (node, part, block, chunk, ids), to be
    read in that order."""

    nodes: DataFrame
    open_ends: DataFrame


def prefix_trie(seqs: DataFrame, most_turns: int = SEGMENT_TURNS,
                most_rows: int = SEGMENT_ROWS) -> Trie:
    """The trie of all sequences (conv_id unique, turns array<struct<h, w>>), from segments of
    at most so many turns and conversations."""
    ship(seqs.sparkSession)
    segments = sorted_segments(seqs, most_turns, most_rows)
    found = stage(segments.mapInArrow(lean(open_prefixes), OPEN), "open")
    totals = found.groupBy("prefix", "parent", "depth").agg(
        F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.sum("children").alias("closed"), F.max("words").alias("words"),
        F.min(F.struct("part", "block")).alias("first"))
    below = totals.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("prefix")).agg(
        F.count("*").alias("opened"))
    merged = stage(totals.join(below, "prefix", "left").select(
        "prefix", "parent", "depth", "n", "conv_id", "words", "first",
        (F.col("closed") + F.coalesce("opened", F.lit(0))).alias("children")), "merged")
    back = found.select("prefix", "part", "block").join(
        merged.select("prefix", F.struct(
            "prefix", "n", "conv_id", "children", F.col("first.part").alias("part"),
            F.col("first.block").alias("block")).alias("m")), "prefix").groupBy(
        "part", "block").agg(F.collect_list("m").alias("merged"))
    rows = stage(segments.join(back, ["part", "block"]).mapInArrow(lean(segment_nodes), NODE),
                 "nodes")
    sums = rows.where(F.col("prefix").isNotNull()).groupBy("prefix").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = merged.select(F.col("prefix").alias("parent"),
                            F.col("conv_id").alias("parent_conv_id"))
    opened = merged.join(sums, "prefix").join(parents, "parent", "left").select(
        F.col("prefix").alias("node"), "conv_id", "depth", "parent_conv_id",
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves",
        "saved_tokens", F.lit(None).cast("array<bigint>").alias("ends"))
    closed = rows.where(F.col("prefix").isNull()).select(
        F.col("prefix").alias("node"), "conv_id", "depth", "parent_conv_id", "n_convs",
        "n_children", "n_leaves", "saved_tokens", "ends")
    chunks = found.select(F.col("prefix").alias("node"), "part", "block",
                          F.posexplode("ends").alias("chunk", "ids"))
    return Trie(closed.unionByName(opened), chunks)


# ---------------------------------------------------------------- digests

def digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, joined by commas; a node's chunks come in order."""
    node, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                            strict=True):
            text = ",".join(map(str, ids)).encode()
            if key == node:
                state.update(b"," + text)
                continue
            if state is not None:
                done.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256(text)
        if done:
            yield digests(done)
    if state is not None:
        yield digests([(node, state.hexdigest())])


def digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])],
        ["node", "ends_sha256"])


def with_digests(trie: Trie) -> DataFrame:
    """The nodes with a digest of their ends instead of the list.

    Ids of an open node pass through one task in order, as a digest asks for, but as a stream:
    in sorted chunks, of which a task holds one batch.
    """
    ordered = trie.open_ends.repartition("node").sortWithinPartitions(
        "node", "part", "block", "chunk").select("node", "ids")
    streamed = ordered.mapInArrow(lean(digest_chunks), "node binary, ends_sha256 string")

    def joined(ids: Column) -> Column:
        return F.sha2(F.array_join(F.coalesce(ids, F.array().cast("array<bigint>")), ","), 256)

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
             "saved_tokens"]
    closed = trie.nodes.where(F.col("node").isNull()).select(
        *names, joined(F.col("ends")).alias("ends_sha256"))
    opened = trie.nodes.where(F.col("node").isNotNull()).join(streamed, "node", "left").select(
        *names, F.coalesce("ends_sha256", joined(F.col("ends"))).alias("ends_sha256"))
    return closed.unionByName(opened)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All prefixes of the rebuilt conversations."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return with_digests(prefix_trie(rebuilt(conversations)))


OP11_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '')
                         || coalesce(text, ''))[:32] AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, turn
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT conv_id, list(h ORDER BY turn NULLS FIRST, h) AS hs,
         list(w ORDER BY turn NULLS FIRST, h) AS ws
  FROM t GROUP BY conv_id
), k AS (
  SELECT conv_id, hs, ws, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 4 AS h
  FROM s, tab
), b AS (
  SELECT k.conv_id, coalesce(o.hs[:k.h], []) || k.hs[k.h + 1:] AS hs,
         coalesce(o.ws[:k.h], []) || k.ws[k.h + 1:] AS ws
  FROM k LEFT JOIN s o ON o.conv_id = k.conv_id - k.conv_id % 20
), p AS (
  SELECT conv_id, unnest(range(len(hs) + 1)) AS depth, hs, ws FROM b
), n AS (
  SELECT depth, array_to_string(hs[:depth], '') AS key, min(conv_id) AS conv_id,
         count(*) AS n_convs, any_value(hs[:depth]) AS hs,
         CASE WHEN depth > 0 THEN any_value(ws[depth]) ELSE 0 END AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                FILTER (len(hs) = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2
), c AS (
  SELECT depth - 1 AS depth, array_to_string(hs[:depth - 1], '') AS key, count(*) AS n_children
  FROM n WHERE depth > 0 GROUP BY 1, 2
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, key)
), u AS (
  SELECT d AS depth, array_to_string(hs[:d], '') AS key, count(*) FILTER (n_children = 0) AS leaves,
         sum((n_convs - 1) * w) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY 1, 2
)
SELECT m.conv_id, m.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children,
       u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (depth, key)
LEFT JOIN n o ON o.depth = m.depth - 1 AND o.key = array_to_string(m.hs[:m.depth - 1], '')
"""
