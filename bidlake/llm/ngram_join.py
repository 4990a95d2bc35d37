"""N-gram Jaccard join with a prefix tree (operator 3).

Documents are sets of distinct five-word shingles (64-bit hashes). Documents with the same set
form a class, named by a hash of the set; all else is done once per class. Two classes link
when 100 * intersection >= 75 * union.

1. Frequencies. Tasks send each shingle with its classes, packed as arrays, to the partition
   of the shingle; that counts in how many classes it occurs. A shingle that more than one
   in ``1 / HEAVY_SHARE`` documents holds is found beforehand (partial counts; the list is
   bounded by set size / share) and needs no counting, so no partition collects a hot one.
2. Filter. A shingle of one class is in no intersection. A class of size n whose shared
   shingles are fewer than 0.75 n can't link and is dropped; the others keep the shared ones
   in a global order, rarest first.
3. Blocks. Linked classes share one of the first n - ceil(0.75 n) + 1 shingles of the order.
   Components over "shares such a shingle" are the blocks; a link never leaves a block.
4. Join. In a block the ordered sets go into a prefix tree (paths of equal beginnings are
   stored once). A set is matched against the tree: the overlap of a shared path is counted
   once for all sets below it, and a subtree is left when the overlap so far plus what can
   still come (the remaining lengths of either side) is too small, when no set below has a
   fitting size, or when all sets below are already connected to the set: what counts are
   components. So a task reports a spanning forest of links, not all pairs.
   A block of more than ``CHUNK`` sets is cut into chunks; first each chunk is joined alone,
   then pairs of chunks of those blocks that aren't one component yet.
5. Components over the links give the classes' components, and so the documents'.

Defined results: null and empty texts, or texts without words, have an empty set and link with
nothing; with fewer words than five the whole sequence is one shingle; repeated rows are copies;
a null doc_id is never the smallest; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    BLOCK_BYTES,
    blocks,
    lean,
    mix,
    partitions,
    release,
    small_batches,
    stage,
    text_bytes,
)
from .components import connected_components
from .words import byte_class, lowered, word_bounds, word_hashes

SHINGLE = 5
#: Links need SHARE percent of the union in the intersection.
SHARE = 75
#: A shingle in more than this share of the documents counts as heavy.
HEAVY_SHARE = 1 / 200
#: Sets of a block that one task joins at once.
CHUNK = 512
#: Frequencies are told apart up to this value; beyond, the hash alone orders.
MOST = (1 << 31) - 1

WORD = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))
_MULTIPLIERS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = SHINGLE):
    """Sorted distinct shingles of each document, end to end, and each one's document."""
    raw = lowered(raw)
    begin, end, first = word_bounds(raw, offsets, WORD)
    words = word_hashes(raw, begin, end)
    counts = np.diff(first)
    docs = len(counts)
    doc_of = np.repeat(np.arange(docs), counts)
    value = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        value += words[k:k + len(value)] * _MULTIPLIERS[k]
    inside = doc_of[:len(value)] == doc_of[n - 1:] if len(value) else np.zeros(0, bool)
    hashes, owners = [mix(value[inside])], [doc_of[:len(value)][inside]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[first[d]:first[d + 1]] * _MULTIPLIERS[:counts[d]]
        hashes.append(mix(own.sum(keepdims=True) ^ np.uint64(counts[d])))
        owners.append(np.array([d]))
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
        hashes, owners = hashes[new], owners[new]
    return hashes, owners, docs


def set_names(hashes: np.ndarray, owners: np.ndarray, docs: int):
    """Sizes of the sets, and a 64-bit name of each (an order-free sum of mixed hashes)."""
    sizes = np.bincount(owners, minlength=docs)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return sizes, mix((total[at[1:]] - total[at[:-1]]) ^ sizes.astype(np.uint64)).view(np.int64)


def describe(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and name; and shingles that may be heavy, with how many of
    a block's documents hold them."""
    for table in blocks(batches, "text"):
        hashes, owners, docs = shingle_sets(*text_bytes(table.column("text")))
        sizes, names = set_names(hashes, owners, docs)
        ordered, count = np.unique(hashes, return_counts=True)
        often = count >= max(2, share * docs / 2)
        ordered, count = ordered[often].view(np.int64), count[often]
        none = pa.nulls(len(ordered), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(a, pa.int64()) if isinstance(a, np.ndarray) else a, b])
             for a, b in (
                 (table.column("doc_id").combine_chunks().cast(pa.int64()), none),
                 (sizes, none), (names, none),
                 (pa.nulls(docs, pa.int64()), pa.array(ordered)),
                 (pa.nulls(docs, pa.int64()), pa.array(count, pa.int64())))],
            ["doc_id", "n_shingles", "name", "shingle", "n"])


PACKED = "part int, kind int, a binary, b binary, c binary"
#: Kinds of packed rows: shingles with their classes; classes with their sizes; shingles of
#: known frequency with their classes.
COUNT, SIZES, KNOWN = 0, 1, 2


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
         *[pa.array(c, pa.binary()) for c in columns[2:]]], ["part", "kind", "a", "b", "c"])


def deal(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings rows of the same part together, and the parts' bounds in it."""
    part = (mix(key.view(np.uint64)) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def pack_sets(batches: Iterator[pa.RecordBatch], heavy: np.ndarray,
              parts: int) -> Iterator[pa.RecordBatch]:
    """Shingles with their classes, dealt by shingle; sizes and heavy shingles, dealt by class.
    A class goes out once per block."""
    for table in blocks(batches, "text", 2 * BLOCK_BYTES):
        hashes, owners, docs = shingle_sets(*text_bytes(table.column("text")))
        sizes, names = set_names(hashes, owners, docs)
        once = np.zeros(docs, bool)
        once[np.unique(names, return_index=True)[1]] = True
        once &= sizes > 0
        live = once[owners]
        hashes, owners = hashes[live], owners[live]
        rows = []
        if len(heavy):
            slot = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
            hot = heavy[slot] == hashes
        else:
            hot = np.zeros(len(hashes), bool)
        key, name = hashes[~hot], names[owners[~hot]]
        order, at = deal(key, parts)
        key, name = key[order], name[order]
        for p in np.flatnonzero(np.diff(at)):
            cut = slice(at[p], at[p + 1])
            rows.append((p, COUNT, key[cut].tobytes(), name[cut].tobytes(), None))
        own, size = names[once], sizes[once].astype(np.int64)
        order, at = deal(own, parts)
        for p in np.flatnonzero(np.diff(at)):
            cut = order[at[p]:at[p + 1]]
            rows.append((p, SIZES, own[cut].tobytes(), size[cut].tobytes(), None))
        key, name = hashes[hot], names[owners[hot]]
        order, at = deal(name, parts)
        for p in np.flatnonzero(np.diff(at)):
            cut = order[at[p]:at[p + 1]]
            rows.append((p, KNOWN, key[cut].tobytes(), name[cut].tobytes(),
                         np.full(len(cut), MOST, np.int32).tobytes()))
        yield packed_batch(rows)


def count_shingles(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Frequencies of a partition's shingles; those of several classes go to their classes."""
    keys, names = [], []
    for batch in batches:
        rows = batch.to_pydict()
        forward = []
        for part, kind, a, b, c in zip(*rows.values(), strict=True):
            if kind == COUNT:
                keys.append(np.frombuffer(a, np.uint64))
                names.append(np.frombuffer(b, np.int64))
            else:
                forward.append((part, kind, a, b, c))
        if forward:
            yield packed_batch(forward)
    if not keys:
        return
    key, name = np.concatenate(keys), np.concatenate(names)
    del keys, names
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
    key, name = key[new], name[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    df = np.diff(np.append(starts, len(key)))
    many = np.repeat(df >= 2, df)
    df = np.repeat(df, df)[many].astype(np.int32)
    key, name = key[many], name[many]
    order, at = deal(name, parts)
    yield packed_batch([
        (p, KNOWN, key[order[at[p]:at[p + 1]]].tobytes(), name[order[at[p]:at[p + 1]]].tobytes(),
         df[order[at[p]:at[p + 1]]].tobytes()) for p in np.flatnonzero(np.diff(at))])


def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that may link: name, size, shared shingles in the global order with their
    frequencies, and the first ones, of which a linked class has one."""
    held: dict[int, list] = {SIZES: [], KNOWN: []}
    for batch in batches:
        for _, kind, a, b, c in zip(*batch.to_pydict().values(), strict=True):
            held[kind].append((a, b, c))
    if not held[KNOWN]:
        return
    name = np.concatenate([np.frombuffer(a, np.int64) for a, _, _ in held[SIZES]])
    size = np.concatenate([np.frombuffer(b, np.int64) for _, b, _ in held[SIZES]])
    name, first = np.unique(name, return_index=True)
    size = size[first]
    key = np.concatenate([np.frombuffer(a, np.uint64) for a, _, _ in held[KNOWN]])
    of = np.concatenate([np.frombuffer(b, np.int64) for _, b, _ in held[KNOWN]])
    df = np.concatenate([np.frombuffer(c, np.int32) for _, _, c in held[KNOWN]])
    held.clear()
    order = np.lexsort((key, df, of))
    key, of, df = key[order], of[order], df[order]
    # a heavy shingle comes from each block that has the class
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
    key, of, df = key[new], of[new], df[new]
    at = np.searchsorted(of, name, side="left")
    upto = np.searchsorted(of, name, side="right")
    shared = upto - at
    needed = -(-SHARE * size // 100)
    rows = []
    for k in np.flatnonzero((shared >= needed) & (shared > 0)):
        mine = slice(at[k], upto[k])
        head = size[k] - needed[k] + 1 - (size[k] - shared[k])
        rows.append((int(name[k]), int(size[k]), key[mine].tobytes(), df[mine].tobytes(),
                     key[mine][:head].view(np.int64)))
        if len(rows) == 1000:
            yield survivor_batch(rows)
            rows = []
    yield survivor_batch(rows)


def survivor_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, sizes, keys, df, heads = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
         pa.array(df, pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
        ["name", "size", "shingles", "df", "head"])


# ---- prefix tree ---------------------------------------------------------------------------

class Node:
    __slots__ = ("part", "children", "ends", "least", "most", "longest", "member", "uniform")

    def __init__(self, part: np.ndarray):
        self.part, self.children, self.ends = part, {}, []
        self.least, self.most, self.longest = 1 << 62, 0, 0
        self.member, self.uniform = -1, True


class PrefixTree:
    """Ordered sets of local shingle numbers; equal beginnings share a path."""

    def __init__(self, vocabulary: int, sizes: np.ndarray, groups: np.ndarray):
        self.root = Node(np.zeros(0, np.int64))
        self.sizes, self.parent = sizes, groups.copy()
        self.mask = np.zeros(vocabulary, np.int64)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def insert(self, k: int, items: np.ndarray) -> None:
        node, root = self.root, self.find(k)
        while True:
            self.note(node, k, root, len(items))
            if not len(items):
                node.ends.append(k)
                return
            child = node.children.get(int(items[0]))
            if child is None:
                leaf = Node(items)
                self.note(leaf, k, root, 0)
                leaf.ends.append(k)
                node.children[int(items[0])] = leaf
                return
            common = min(len(items), len(child.part))
            differ = np.flatnonzero(items[:common] != child.part[:common])
            cut = int(differ[0]) if len(differ) else common
            if cut < len(child.part):
                upper = Node(child.part[:cut])
                upper.least, upper.most = child.least, child.most
                upper.longest = child.longest + len(child.part) - cut
                upper.member, upper.uniform = child.member, child.uniform
                child.part = child.part[cut:]
                upper.children[int(child.part[0])] = child
                node.children[int(items[0])] = upper
                child = upper
            node, items = child, items[cut:]

    def note(self, node: Node, k: int, root: int, below: int) -> None:
        size = int(self.sizes[k])
        node.least, node.most = min(node.least, size), max(node.most, size)
        node.longest = max(node.longest, below)
        if node.member < 0:
            node.member = k
        elif node.uniform and self.find(node.member) != root:
            node.uniform = False

    def links(self, k: int, items: np.ndarray) -> list[int]:
        """Sets of the tree that link with set ``k`` and weren't connected with it; connects
        them."""
        size, found = int(self.sizes[k]), []
        mask = self.mask
        mask[items] = 1
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.member < 0 or SHARE * node.least > 100 * size or \
                    100 * node.most < SHARE * size:
                continue
            if node.uniform and self.find(node.member) == self.find(k):
                continue
            left = len(items)
            if len(node.part):
                overlap += int(mask[node.part].sum())
                left -= int(np.searchsorted(items, node.part[-1], side="right"))
            needed = -(-SHARE * (size + max(node.least, -(-SHARE * size // 100))) // (100 + SHARE))
            for end in node.ends:
                other = int(self.sizes[end])
                if 100 * overlap >= SHARE * (size + other - overlap):
                    a, b = self.find(end), self.find(k)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        found.append(end)
            if overlap + min(left, node.longest) >= needed:
                stack.extend((child, overlap) for child in node.children.values())
        mask[items] = 0
        return found


def join_sets(rows: list[dict]) -> list[tuple[int, int]]:
    """Links that connect the sets of one task. A pair is looked for if the task has both
    chunks of a pair and the sets are of different ones, or has one chunk only."""
    sides = np.array([r["side"] for r in rows])
    keys = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    df = [np.frombuffer(r["df"], np.int32) for r in rows]
    every, frequency = np.concatenate(keys), np.concatenate(df)
    vocabulary, first, place = np.unique(every, return_index=True, return_inverse=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, frequency[first]))] = np.arange(len(vocabulary))
    local = np.split(rank[place.reshape(-1)], np.cumsum([len(x) for x in keys])[:-1])
    labels = np.array([r["label"] for r in rows])
    groups = np.unique(labels, return_index=True, return_inverse=True)
    parent = groups[1][groups[2].reshape(-1)]
    tree = PrefixTree(len(vocabulary), np.array([r["size"] for r in rows]), parent)
    out = []
    if len(set(sides)) > 1:
        for k in np.flatnonzero(sides == 0):
            tree.insert(int(k), local[k])
        for k in np.flatnonzero(sides == 1):
            out += [(k, other) for other in tree.links(int(k), local[k])]
    else:
        for k in range(len(rows)):
            out += [(k, other) for other in tree.links(k, local[k])]
            tree.insert(k, local[k])
    return [(rows[a]["name"], rows[b]["name"]) for a, b in out]


def join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; one task's rows are held at a time."""
    def out(pairs):
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                          ["u", "v"])

    held, task, pairs = [], None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["task"] != task and held:
                pairs += join_sets(held)
                held = []
            task = row["task"]
            held.append(row)
        if len(pairs) > 10_000:
            yield out(pairs)
            pairs = []
    if held:
        pairs += join_sets(held)
    yield out(pairs)


def joined(tasks: DataFrame) -> DataFrame:
    """Links found in all tasks (task, side, name, size, label, shingles, df)."""
    return (tasks.repartition(partitions(tasks.sparkSession), "task")
            .sortWithinPartitions("task", "name")
            .mapInArrow(lean(join_batches), "u bigint, v bigint"))


def set_links(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links between ``sets`` (survivors) that connect what is linked."""
    heads = sets.select("name", F.explode("head").alias("shingle"))
    least = heads.groupBy("shingle").agg(F.min("name").alias("least"), F.count("*").alias("n"))
    edges = (heads.join(least.where(F.col("n") > 1), "shingle")
             .select(F.col("name").alias("u"), F.col("least").alias("v"))
             .where(F.col("u") != F.col("v")).distinct())
    block = connected_components(edges)
    sizes = block.groupBy("component").agg(F.count("*").alias("members"))
    placed = stage(
        sets.drop("head").join(block, sets["name"] == block["node"]).drop("node")
        .join(sizes, "component")
        .withColumn("chunks", F.ceil(F.col("members") / chunk))
        .withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks"))), "blocks")
    alone = placed.select(
        F.xxhash64("component", "chunk").alias("task"), F.lit(0).alias("side"), "name", "size",
        F.col("name").alias("label"), "shingles", "df")
    links = stage(joined(alone), "links")
    large = placed.where(F.col("chunks") > 1)
    if large.isEmpty():
        return links
    found = connected_components(links)
    labelled = large.join(found.withColumnRenamed("component", "label"),
                          large["name"] == found["node"], "left").drop("node").withColumn(
        "label", F.coalesce("label", "name"))
    split = (labelled.groupBy("component").agg(
        F.min("label").alias("low"), F.max("label").alias("high"))
        .where(F.col("low") != F.col("high")).select("component"))
    rest = labelled.join(split, "component").withColumn("other", F.explode(
        F.sequence(F.lit(0), F.col("chunks") - 1))).where(F.col("other") != F.col("chunk"))
    pairs = rest.select(
        F.xxhash64("component", F.least("chunk", "other"), F.greatest("chunk", "other"))
        .alias("task"),
        F.when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"),
        "name", "size", "label", "shingles", "df")
    # what is connected already comes as stars, which the last components step keeps
    stars = found.where(F.col("node") != F.col("component")).select(
        F.col("node").alias("u"), F.col("component").alias("v"))
    return stars.unionByName(joined(pairs))


def near_duplicates(documents: DataFrame, chunk: int = CHUNK,
                    heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stage(source.mapInArrow(
        lean(lambda b: describe(b, heavy_share)),
        "doc_id bigint, n_shingles bigint, name bigint, shingle bigint, n bigint"), "sets")
    named = described.where(F.col("name").isNotNull()).select("doc_id", "n_shingles", "name")
    total = named.count()
    heavy = [r["shingle"] for r in described.where(F.col("shingle").isNotNull())
             .groupBy("shingle").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= max(2.0, heavy_share * total / 2)).collect()]
    shared = spark.sparkContext.broadcast(np.sort(np.array(heavy, np.int64).view(np.uint64)))
    packed = source.select("text").mapInArrow(
        lean(lambda b: pack_sets(b, shared.value, parts)), PACKED)
    counted = packed.repartitionById(parts, F.col("part")).mapInArrow(
        lean(lambda b: count_shingles(b, parts)), PACKED)
    sets = stage(counted.repartitionById(parts, F.col("part")).mapInArrow(
        lean(survivors),
        "name bigint, size bigint, shingles binary, df binary, head array<bigint>"), "survivors")
    found = connected_components(set_links(sets, chunk))
    release(sets)
    classes = named.groupBy("name", "n_shingles").agg(F.min("doc_id").alias("least"))
    labelled = classes.where(F.col("n_shingles") > 0).join(
        found, classes["name"] == found["node"], "left").select(
        "name", "least", F.coalesce("component", "name").alias("component"))
    smallest = Window.partitionBy("component")
    components = labelled.select("name", F.min("least").over(smallest).alias("component_id"))
    return (named.join(components, "name", "left")
            .select("doc_id", "n_shingles", F.when(
                F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
                F.col("component_id")).alias("component_id")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` (all columns) without those that link, directly or not, to a smaller
    doc_id. Rows of equal doc_id stay together; rows without doc_id stay."""
    found = near_duplicates(documents)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
