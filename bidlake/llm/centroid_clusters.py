"""Centroid clustering with a table of pivot distances (LAESA; operator 13).

Vectors are integers, so all distances are exact. A few pivots are fixed before the first
round: of the starting centroids those that lie farthest from each other. The distance of every
vector to every pivot is computed once and written beside the vector.

A round is one pass over that table. For a vector x, a centroid c and a pivot p,
|d(x, p) - d(c, p)| <= d(x, c), so the greatest difference over the pivots bounds the distance
from below without reading the vector's components. The centroid with the least bound gets its
exact integer distance first; of the others, only those whose bound does not exceed it do. Bounds
are lowered by more than the rounding error of the roots, so no nearest centroid is lost.

Each task sums its vectors by cluster, so what is shuffled is one row per task and cluster; the
driver holds the k centroids and nothing else. New centroids are exact floors of sum / count.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite components take no part. Components beyond +-2**19 (integers beyond 2**27) stop the
job with a message, as squared distances would leave 64 bits. A row without an id is assigned
like any other, but never starts a centroid; rows with one id and different vectors are told
apart, in the start by their components; fewer than k vectors make fewer centroids; without any
vector the result is empty. Sums beyond 64 bits are null. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, stage

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
PIVOTS = 8
#: Integers stay within +-2**27, so a squared distance fits into 64 bits.
MOST = 1 << 27
#: Vectors handled at once inside a task.
ROWS = 2048

ASSIGNED = "vec_id {id}, cluster int, distance bigint"


def quantized(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int,
              scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    x = F.col("x")
    usable = (F.size(x) == dimensions) & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    scaled = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))))
    fits = ~F.exists(x, lambda e: F.abs(e) * F.lit(float(scale)) >= F.lit(float(MOST)))
    return (vectors.select(F.col(vec_id).alias("vec_id"),
                           F.col(embedding).cast("array<double>").alias("x"))
            .where(F.col("x").isNotNull() & usable)
            .select("vec_id", F.when(fits, scaled).otherwise(F.raise_error(F.lit(
                "a component is too large for exact 64-bit distances"))).cast("array<int>")
                .alias("v")))


def starting_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hash of ``seed:vec_id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = (vectors.where(F.col("vec_id").isNotNull()).select(order.alias("h"), "v")
             .orderBy("h", "v").limit(k).collect())
    return np.array([r["v"] for r in first], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    step = a - b
    return np.einsum("...i,...i->...", step, step)


def far_apart(centroids: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` different rows: the first, then each time the farthest from those before."""
    chosen = [0]
    nearest = squared(centroids, centroids[0])
    while len(chosen) < most and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(centroids, centroids[chosen[-1]]))
    return centroids[chosen]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def with_pivots(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each vector with its exact squared distances to the pivots."""
    for batch in batches:
        v = matrix(batch.column(1), pivots.shape[1]).astype(np.int64)
        out = np.stack([squared(v, p) for p in pivots], 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * len(pivots),
                                      pa.array(out.ravel()))], ["vec_id", "v", "p"])


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray,
            between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, and how many exact distances it took.

    ``to_pivots`` holds the vectors' squared distances to the pivots, ``between`` those of the
    centroids.
    """
    x, c = np.sqrt(to_pivots.astype(float)), np.sqrt(between.astype(float))
    bound = np.zeros((len(v), len(centroids)))
    for p in range(x.shape[1]):
        np.maximum(bound, np.abs(x[:, p, None] - c[None, :, p]), out=bound)
    # what rounding may have added: a root is off by less than 2**-52 of its value
    bound -= (x.max(1)[:, None] + c.max(1)[None, :]) * 2.0 ** -48
    cluster = bound.argmin(1)
    distance = squared(v, centroids[cluster])
    tried = len(v)
    first = cluster.copy()
    for j in range(len(centroids)):
        # a bound's square is compared with slack of one, as the root of a long may round down
        rows = np.flatnonzero((first != j) & (bound[:, j] <= np.sqrt(distance + 1.0)))
        exact = squared(v[rows], centroids[j])
        better = (exact < distance[rows]) | ((exact == distance[rows]) & (j < cluster[rows]))
        cluster[rows[better]] = j
        distance[rows[better]] = exact[better]
        tried += len(rows)
    return cluster, distance, tried


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray,
             pivots: np.ndarray) -> Iterator[tuple]:
    """(ids, vectors, cluster, distance) in blocks of few rows."""
    between = np.stack([squared(centroids, p) for p in pivots], 1)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            v = matrix(part.column(1), centroids.shape[1]).astype(np.int64)
            cluster, distance, _ = nearest(v, matrix(part.column(2), len(pivots)), centroids,
                                           between)
            yield part.column(0), v, cluster, distance


def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray,
         pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per cluster that the task has vectors of: (cluster, n, sums of components)."""
    k, width = centroids.shape
    total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for _, v, cluster, _ in assigned(batches, centroids, pivots):
        order = np.argsort(cluster, kind="stable")
        held, starts = np.unique(cluster[order], return_index=True)
        total[held] += np.add.reduceat(v[order], starts)
        count += np.bincount(cluster, minlength=k)
    held = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(held.astype(np.int32)), pa.array(count[held]),
         pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * width,
                                  pa.array(total[held].ravel()))], ["cluster", "n", "s"])


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape
    parts = table.mapInArrow(lean(lambda batches: sums(batches, centroids, pivots)),
                             "cluster int, n bigint, s array<bigint>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(width)]).alias("s")).collect()
    after = centroids.copy()
    for r in rows:
        after[r["cluster"]] = [int(x) // r["n"] for x in r["s"]]
    return after


def labels(batches: Iterator[pa.RecordBatch], centroids: np.ndarray,
           pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, _, cluster, distance in assigned(batches, centroids, pivots):
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)],
            ["vec_id", "cluster", "distance"])


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
            k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2,
            dimensions: int = DIMENSIONS, scale: int = SCALE,
            n_pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of all vectors that take part, and the clusters: (cluster,
    centroid array<bigint>, n_vectors, cluster_inertia, inertia), at most k rows."""
    spark = vectors.sparkSession
    ship(spark)
    kept = quantized(vectors, vec_id, embedding, dimensions, scale)
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids = starting_centroids(kept, k, seed)
    if not len(centroids):
        return (kept.select("vec_id", F.lit(0).alias("cluster"),
                            F.lit(0).cast("bigint").alias("distance")).limit(0),
                spark.createDataFrame([], "cluster int, centroid array<bigint>, n_vectors bigint, "
                                          "cluster_inertia bigint, inertia bigint"))
    pivots = far_apart(centroids, n_pivots)
    table = stage(kept.mapInArrow(lean(lambda batches: with_pivots(batches, pivots)),
                                  f"vec_id {kind}, v array<int>, p array<bigint>"), "pivots")
    for _ in range(rounds):
        after = moved(table, centroids, pivots)
        same = np.array_equal(after, centroids)
        centroids = after
        if same:  # further rounds would not change it either
            break
    members = stage(table.mapInArrow(lean(lambda batches: labels(batches, centroids, pivots)),
                                     ASSIGNED.format(id=kind)), "clusters")
    own = {r["cluster"]: r for r in members.groupBy("cluster").agg(
        F.count("*").alias("n"),
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(int(r["d"]) for r in own.values())

    def fitting(x: int) -> int | None:
        return x if x < 1 << 63 else None

    rows = [(j, [int(x) for x in centroids[j]], own[j]["n"] if j in own else 0,
             fitting(int(own[j]["d"])) if j in own else 0, fitting(whole))
            for j in range(len(centroids))]
    return members, spark.createDataFrame(
        rows, "cluster int, centroid array<bigint>, n_vectors bigint, cluster_inertia bigint, "
              "inertia bigint")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """40 clusters of all embeddings after five rounds; a digest stands for the centroid."""
    members, clusters = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = clusters.select(
        "cluster", "cluster_inertia", "inertia",
        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))
    return members.join(F.broadcast(digests), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by all distances of all rounds, in SQL."""
    text = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, i, floor({SCALE} * e[i]::DOUBLE)::BIGINT AS x
  FROM kept, range(1, {DIMENSIONS + 1}) t(i)
), first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c
  FROM kept WHERE vec_id IS NOT NULL
), c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN x USING (r) WHERE c < {k})"""
    near = """, a{n} AS MATERIALIZED (
  SELECT r, min_by(c, d * 1000 + c) AS c, min(d) AS d FROM (
    SELECT r, c, sum((x.x - y.x) * (x.x - y.x)) AS d FROM x JOIN c{n} y USING (i)
    GROUP BY r, c) GROUP BY r
)"""
    for n in range(rounds):
        text += near.format(n=n) + f""", c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{n} LEFT JOIN (
    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY c, i
  ) USING (c, i)
)"""
    return text + near.format(n=rounds) + f""", h AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c
)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance,
       (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)
"""


OP13_SQL = clustering_sql()
