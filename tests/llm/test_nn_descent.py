import numpy as np
from pyspark.sql import functions as F

from bidlake.llm.nn_descent import nearest, op6_nn_descent

SCHEMA = "vec_id bigint, embedding array<double>, node int"


def brute(rows, queries, k=20):
    ids = np.array([i for i, _ in rows])
    data = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        score = data @ data[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df, every, **more):
    out = {}
    for r in nearest(df, F.col("vec_id") % every == 0, **more).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in x}) for q, x in want.items()) \
        / sum(map(len, want.values()))


def test_table_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet")
            .select("vec_id", "embedding").collect()]
    got = {}
    for r in op6_nn_descent(spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert recall(got, brute(rows, [i for i, _ in rows if i % 20 == 0])) >= 0.9


def test_graph_search_recall(spark):
    """More rows than a leaf holds, so that neighbours must be found through the graph; norms
    differ, one tight cluster holds a third of the rows."""
    rng = np.random.default_rng(1)
    data = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    data[:500] = data[0] + 0.05 * rng.standard_normal((500, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = found(df, 50, leaf=60, trees=2)
    assert recall(got, brute(rows, range(0, 1500, 50))) >= 0.9


def test_recall_among_near_copies(spark):
    """A third of the rows within a relative spread of 0.01: their inner products differ by
    less than half precision can tell."""
    rng = np.random.default_rng(2)
    data = rng.standard_normal((3000, 64))
    data[:1000] = data[0] + 0.01 * rng.standard_normal((1000, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data = data.astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    df = spark.createDataFrame([(*r, 1) for r in rows],
                               SCHEMA.replace("double", "float"))
    got = found(df, 50)
    want = brute(rows, range(0, 3000, 50))
    assert recall(got, want) >= 0.9
    assert recall(got, {q: x for q, x in want.items() if q < 1000}) >= 0.9


def test_edge_cases(spark):
    """Copies, ties, vectors that take no part, few candidates: exact results."""
    good = [(k, [1.0, float(k % 3)]) for k in range(60)] + [(60, [1.0, 0.5])]
    bad = [(70, None), (80, [0.0, 0.0]), (90, [1.0, None]), (100, [float("nan"), 1.0]),
           (110, [float("inf"), 1.0]), (120, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (130, [])]
    df = spark.createDataFrame([(*r, 1) for r in good + bad + [good[5]]], SCHEMA)
    assert found(df, 10) == brute(good, range(0, 61, 10))
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, -1.0], 1)], SCHEMA)
    assert found(few, 10) == {0: [(1, 0.0)]}
    assert found(few.where("vec_id = 0"), 10) == {}
    assert found(few.where("false"), 10) == {}
