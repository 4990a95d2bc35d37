"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search
(operator 6).

Graph: equal vectors form one node. A first graph comes from leaves of random hyperplane
codes; a leaf with too many nodes is split by a hash, so all leaves are small. Then each round
joins every node's neighbours and reverse neighbours (two joins of edges with vectors, by
Spark), compares those pairs of them of which one edge is new, and keeps each node's best; it
ends when few edges are new. Only pairs that beat the present worst neighbour leave a task.

Search: a query starts at its own node's neighbours. Each round expands the unexpanded nodes
among its ``BEAM`` best: a join with the graph gives the neighbours, a join with the nodes
their vectors. It ends when the beam is expanded. The beam is then scored in double precision
on the original vectors, and nodes become their members.

In the graph all vectors are scaled by a power of two and get one more component that makes
their norms equal, so nearness there is nearness by inner product. Nodes hold the table's own
numbers without rounding (single or double precision, as the column), and all products are
summed in double precision: the inner products of near copies differ by very little.

``BEAM``, ``DEGREE`` and ``LEAF`` are parameters of an approximate index, which
holds every row. Of a hub's reverse neighbours the best 3 * ``DEGREE`` take part in a join (the
best ``DEGREE`` in a search); the forward edges hold the others.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller vec_id; rows without a vec_id take
no part; of rows that share a vec_id and a vector one counts; a query without candidates has no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, release, small_batches, stage

NEIGHBOURS = 20
DEGREE = 48
BEAM = 112
LEAF = 400
TREES = 8
#: Rounds end when fewer than this share of all edges is new.
SETTLED = 0.01


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0),
                      F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda t, x: t + x)


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Binary values of equal length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def encode(batches: Iterator[pa.RecordBatch], scale: float, norm: float,
           dtype: str) -> Iterator[pa.RecordBatch]:
    """Scaled vectors, with the component that evens out the norms."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.array(batch.column(1).to_pylist(), float) / scale
        rest = np.sqrt(np.maximum(0, (norm / scale) ** 2 - (rows * rows).sum(1)))
        data = np.concatenate([rows, rest[:, None]], 1).astype(dtype)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r.tobytes() for r in data], pa.binary())],
            ["node", "vec"])


EDGES = "src bigint, dst bigint, score double, new boolean"


def edge_batch(src, dst, score, new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(score, pa.float64()),
         pa.array(new, pa.bool_())], ["src", "dst", "score", "new"])


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def leaf_edges(batches: Iterator[pa.RecordBatch], degree: int,
               dtype: str) -> Iterator[pa.RecordBatch]:
    """Each leaf's best neighbours among its nodes."""
    for leaf in by_key(batches, "leaf"):
        ids = np.asarray(leaf.column("node"))
        if len(ids) < 2:
            continue
        rows = matrix(leaf.column("vec"), dtype).astype(float)
        k = min(degree, len(ids) - 1)
        for at in range(0, len(ids), 1024):
            score = rows[at:at + 1024] @ rows.T
            n = len(score)
            score[np.arange(n), np.arange(at, at + n)] = -np.inf
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            yield edge_batch(np.repeat(ids[at:at + n], k), ids[best].ravel(),
                             np.take_along_axis(score, best, 1).ravel(), np.ones(n * k, bool))


def keep_best(batches: Iterator[pa.RecordBatch], degree: int) -> Iterator[pa.RecordBatch]:
    """Each node's best edges; an edge that was there before isn't new."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    src, dst, score, new = (np.asarray(table.column(c).combine_chunks().cast(
        pa.uint8()) if c == "new" else table.column(c)) for c in ("src", "dst", "score", "new"))
    order = np.lexsort((new, dst, src))
    src, dst, score, new = src[order], dst[order], score[order], new[order]
    first = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
    src, dst, score, new = src[first], dst[first], score[first], new[first]
    order = np.lexsort((dst, -score, src))
    src, dst, score, new = src[order], dst[order], score[order], new[order]
    top = np.arange(len(src)) - np.searchsorted(src, src) < degree
    yield edge_batch(src[top], dst[top], score[top], new[top].astype(bool))


def best_edges(edges: DataFrame, degree: int) -> DataFrame:
    return edges.repartition(partitions(edges.sparkSession), "src").mapInArrow(
        lambda b: keep_best(b, degree), EDGES)


def local_join(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """Pairs among the (reverse) neighbours of each node that improve one of the two."""
    out, size = [], 0
    for group in by_key(batches, "hub"):
        ids, first = np.unique(np.asarray(group.column("node")), return_index=True)
        new = np.asarray(group.column("new").combine_chunks().cast(pa.uint8())).astype(bool)
        if len(ids) < 2 or not new.any():
            continue
        fresh = np.zeros(len(ids), bool)
        fresh[np.searchsorted(ids, np.asarray(group.column("node"))[new])] = True
        low = np.asarray(group.column("low"))[first]
        rows = matrix(group.column("vec").take(pa.array(first)), dtype).astype(float)
        score = rows @ rows.T
        better = (score > low[:, None]) & (fresh[:, None] | fresh[None])
        np.fill_diagonal(better, False)
        a, b = np.nonzero(better)
        if len(a):
            out.append((ids[a], ids[b], score[a, b]))
            size += len(a)
        if size > 100_000:
            src, dst, value = (np.concatenate(x) for x in zip(*out))
            yield edge_batch(src, dst, value, np.ones(len(src), bool))
            out, size = [], 0
    if out:
        src, dst, value = (np.concatenate(x) for x in zip(*out))
        yield edge_batch(src, dst, value, np.ones(len(src), bool))


def first_graph(nodes: DataFrame, count: int, width: int, degree: int, leaf: int,
                trees: int, dtype: str) -> DataFrame:
    """Edges inside the leaves of ``trees`` random hyperplane codes."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / leaf)))))
    planes = np.random.default_rng(7).standard_normal((trees, max(1, bits), width))

    def codes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(1), dtype).astype(float)
            weights = 2.0 ** np.arange(planes.shape[1]) * (bits > 0)
            for t in range(trees):
                code = ((rows @ planes[t].T) > 0) @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)),
                     pa.array(code.astype(np.int64)), batch.column(0), batch.column(1)],
                    ["tree", "code", "node", "vec"])

    coded = nodes.mapInArrow(codes, "tree int, code bigint, node bigint, vec binary")
    sizes = coded.groupBy("tree", "code").agg(F.count("*").alias("n"))
    leaves = coded.join(sizes, ["tree", "code"]).select(
        F.xxhash64("tree", "code", F.pmod(F.xxhash64("node", "tree"), F.ceil(
            F.col("n") / (2 * leaf)))).alias("leaf"), "node", "vec")
    edges = (leaves.repartition(partitions(nodes.sparkSession), "leaf")
             .sortWithinPartitions("leaf").mapInArrow(lambda b: leaf_edges(b, degree, dtype), EDGES))
    return best_edges(edges, degree)


def reverse_best(edges: DataFrame, degree: int) -> DataFrame:
    """The best ``degree`` edges into each node, turned round."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score", "new")
    rank = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return turned.withColumn("r", F.row_number().over(rank)).where(
        F.col("r") <= degree).drop("r")


def descend(nodes: DataFrame, graph: DataFrame, count: int, degree: int,
            dtype: str) -> DataFrame:
    """NN-descent rounds on ``graph`` until it settles; edges only get better, so it does."""
    spark = nodes.sparkSession
    while True:
        worst = graph.groupBy("src").agg(F.min("score").alias("low"), F.count("*").alias("n"))
        valued = nodes.join(worst, nodes["node"] == worst["src"], "left").select(
            "node", "vec", F.when(F.col("n") >= degree, F.col("low")).otherwise(
                F.lit(float("-inf"))).alias("low"))
        near = graph.unionByName(reverse_best(graph, 3 * degree)).select(
            F.col("src").alias("hub"), F.col("dst").alias("node"), "new")
        members = (near.join(valued, "node").select("hub", "node", "new", "low", "vec")
                   .repartition(partitions(spark), "hub").sortWithinPartitions("hub"))
        found = members.mapInArrow(lambda b: local_join(b, dtype), EDGES)
        old = graph.withColumn("new", F.lit(False))
        better = stage(best_edges(old.unionByName(found), degree), "graph")
        release(graph)
        graph = better
        if graph.where("new").count() <= SETTLED * count * degree:
            return graph


STATE = ("query bigint, vec binary, ids array<bigint>, scores array<double>, "
         "expanded array<boolean>")


def advance(state: pd.DataFrame, found: pd.DataFrame, beam: int, dtype: str) -> pd.DataFrame:
    """A query's beam after looking at its new candidates."""
    if state.empty:
        return state
    row = state.iloc[0]
    ids, scores = np.asarray(row["ids"]), np.asarray(row["scores"], float)
    expanded = np.ones(len(ids), bool)
    if len(found):
        fresh = ~np.isin(found["node"].to_numpy(), ids)
        more = found["node"].to_numpy()[fresh]
        if len(more):
            rows = np.frombuffer(b"".join(found["near"][fresh]), dtype).reshape(
                len(more), -1)[:, :-1].astype(float)
            # summed row by row, so that a node always scores alike and one cut stays cut
            value = (rows * np.frombuffer(row["vec"], dtype)[:-1].astype(float)).sum(1)
            ids, scores = np.concatenate([ids, more]), np.concatenate([scores, value])
            expanded = np.concatenate([expanded, np.zeros(len(more), bool)])
    order = np.lexsort((ids, -scores))[:beam]
    return pd.DataFrame({"query": [row["query"]], "vec": [row["vec"]], "ids": [ids[order]],
                         "scores": [scores[order]], "expanded": [expanded[order]]})


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int,
           degree: int, dtype: str) -> DataFrame:
    """(query, node) of each query's beam; ``queries`` holds (query, node)."""
    near = stage(graph.unionByName(reverse_best(graph, degree)).select("src", "dst").distinct(),
                 "near")
    state = stage(queries.join(nodes, "node").select(
        "query", "vec", F.array("node").alias("ids"),
        F.array(F.lit(float("inf"))).alias("scores"),
        F.array(F.lit(False)).alias("expanded")), "beam")
    while True:
        opened = (state.select(F.col("query").alias("asker"),
                               F.explode(F.arrays_zip("ids", "expanded")).alias("x"))
                  .where(~F.col("x.expanded")).select("asker", F.col("x.ids").alias("src")))
        wanted = opened.join(near, "src").select("asker", F.col("dst").alias("node")).distinct()
        held = state.select(F.col("query").alias("asker"), F.explode("ids").alias("node"))
        wanted = wanted.join(held, ["asker", "node"], "left_anti")
        found = wanted.join(nodes, "node").select("asker", "node", F.col("vec").alias("near"))
        after = stage(state.groupBy("query").cogroup(found.groupBy("asker")).applyInPandas(
            lambda s, f: advance(s, f, beam, dtype), STATE), "beam")
        release(state)
        state = after
        if state.where(F.exists("expanded", lambda x: ~x)).isEmpty():
            return state.select("query", F.explode("ids").alias("node"))


def nearest(embeddings: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS,
            degree: int = DEGREE, beam: int = BEAM, leaf: int = LEAF, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows of ``embeddings``
    (vec_id, embedding) found; ``is_query`` is a condition on vec_id."""
    small_batches(embeddings.sparkSession, 10_000)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = (rows.groupBy(F.size("embedding").alias("d")).count()
              .orderBy(F.desc("count"), "d").limit(1).collect())
    width = common[0]["d"] if common else 0
    rows = rows.where(F.size("embedding") == width)
    classes = stage(rows.groupBy("embedding").agg(F.min("vec_id").alias("node")), "classes")
    row = classes.agg(F.count("*").alias("n"), F.max(F.sqrt(dot(
        F.col("embedding"), F.col("embedding")))).alias("norm")).first()
    count, norm = row["n"], row["norm"] or 1.0
    scale = 2.0 ** np.ceil(np.log2(norm))
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    dtype = "float32" if single else "float64"
    members = stage(rows.join(classes, "embedding").select("node", "vec_id").distinct(),
                    "members")
    nodes = stage(classes.select("node", "embedding").mapInArrow(
        lambda b: encode(b, scale, norm, dtype), "node bigint, vec binary"), "nodes")
    graph = stage(first_graph(nodes, count, width + 1, degree, leaf, trees, dtype), "graph")
    graph = descend(nodes, graph, count, degree, dtype)
    queries = members.where(is_query).select(F.col("vec_id").alias("query"), "node")
    found = search(queries, nodes, graph, beam, degree, dtype)
    # a query needs at most its neighbours and itself from a node's members
    rank = Window.partitionBy("node").orderBy("vec_id")
    few = members.withColumn("r", F.row_number().over(rank)).where(
        F.col("r") <= neighbours + 1).drop("r")
    own = queries.join(classes, "node").select("query", F.col("embedding").alias("mine"))
    scored = (found.join(classes, "node").join(own, "query")
              .select("query", "node", dot(F.col("mine"), F.col("embedding")).alias("score")))
    pairs = scored.join(few, "node").where(F.col("vec_id") != F.col("query"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= neighbours)
            .select(F.col("query").alias("query_id"), "rank", "vec_id", "score"))


def op6_nn_descent(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"),
                   F.col("vec_id") % 20 == 0)
