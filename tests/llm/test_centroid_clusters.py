"""Clusters against a plain version that measures every distance."""

import hashlib
import math
import random

import numpy as np
import pytest

from bidlake.llm import centroid_clusters as C

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, p int, v string, n double"


def plain(rows, k=C.CLUSTERS, rounds=C.ROUNDS, dimensions=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dimensions
            and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v)
                   for i, v in kept if i is not None)
    centroids = [v for _, v in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j)
                   for j, c in enumerate(centroids))

    if not centroids:
        return []
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                   for i, d, j in found), key=str)


def ours(spark, rows, **given):
    table = spark.createDataFrame([(i, e, "c", 1, "v", 0.5) for i, e in rows], SCHEMA)
    members, clusters = C.cluster(table, **given)
    by = {r["cluster"]: r for r in clusters.collect()}
    return sorted(((r["vec_id"], r["cluster"], r["distance"],
                    by[r["cluster"]]["cluster_inertia"], by[r["cluster"]]["inertia"],
                    hashlib.sha256(",".join(map(str, by[r["cluster"]]["centroid"])).encode())
                    .hexdigest()) for r in members.collect()), key=str)


def vectors(n, seed, spread=1.0, dimensions=64):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dimensions)] for _ in range(5)]
    return [(i, [x + spread * rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_equals_all_distances(spark, spread):
    rows = vectors(300, 7, spread)
    assert ours(spark, rows) == plain(rows)


def test_ties_copies_and_rows_that_take_no_part(spark):
    one, nan = [0.5] * 64, float("nan")
    rows = ([(i, one) for i in range(60)] + [(60, [0.0] * 64), (61, [-0.001] * 64)]
            + [(5, one), (5, [0.25] * 64), (None, one), (None, [0.1] * 64)]
            + [(70, None), (71, []), (72, [1.0] * 63), (73, [1.0] * 65), (74, [nan] * 64),
               (75, [None] + [1.0] * 63), (76, [float("inf")] * 64), (77, [0.0] * 64)])
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, rows, k=3) == plain(rows, k=3)


def test_few_none_and_empty(spark):
    assert ours(spark, vectors(3, 1)) == plain(vectors(3, 1))
    assert ours(spark, []) == [] == ours(spark, [(1, None)])


def test_large_components_stay_exact_or_stop(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-5e5, 5e5) for _ in range(64)]) for i in range(80)]
    expected = [(i, j, d, own, None, h) for i, j, d, own, whole, h in plain(rows)]
    assert ours(spark, rows) == expected and plain(rows)[0][4] >= 1 << 63
    with pytest.raises(Exception, match="too large"):
        ours(spark, [(1, [1e30] * 64)])


def test_bounds_spare_exact_distances():
    rows = np.array([[math.floor(256 * x) for x in e] for _, e in vectors(400, 2, 0.05)], np.int64)
    centroids = rows[:40]
    pivots = C.far_apart(centroids, C.PIVOTS)
    to = np.stack([C.squared(rows, p) for p in pivots], 1)
    cluster, distance, tried = C.nearest(
        rows, to, centroids, np.stack([C.squared(centroids, p) for p in pivots], 1))
    every = np.stack([C.squared(rows, c) for c in centroids], 1)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert tried < every.size / 2


def test_query(spark, sf_small):
    rows = [(r["vec_id"], r["embedding"]) for r in
            spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    got = C.op13_centroid_clusters(spark, sf_small).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
