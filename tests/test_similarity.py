"""The k most similar campaigns against all pairs."""

import glob
import math
import os
import random
import re
import time
from collections import defaultdict

import pytest

from bidlake.operators import similarity as S
from bidlake.sources import files

SCHEMA = "campaign string, dimension int, weight int"


def plain(rows, k):
    vectors = defaultdict(lambda: defaultdict(int))
    for c, d, w in rows:
        if c is not None and d is not None and (w or 0) > 0:
            vectors[c][d] += w
    out = {}
    for c, v in vectors.items():
        likes = []
        for o, u in vectors.items():
            dot = sum(w * u.get(d, 0) for d, w in v.items())
            if o != c and dot:
                lengths = sum(w * w for w in v.values()) * sum(w * w for w in u.values())
                likes.append((-dot / math.sqrt(lengths), o))
        for r, (s, o) in enumerate(sorted(likes)[:k], 1):
            out[c, r] = (o, pytest.approx(-s))
    return out


def groups(n, seed, common=True):
    """Campaigns in groups of six that share dimensions of their own; one that all share."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        g = c // 6
        rows += [(f"c{c:03}", 100 * g + d, rng.randint(1, 50)) for d in rng.sample(range(20), 12)]
        if common:
            rows.append((f"c{c:03}", -1, rng.randint(1, 5)))
    return rows


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equals_all_pairs(spark, k):
    rows = groups(90, k) + [("c000", 3, 4), ("c000", 3, 4), (None, 3, 1), ("c001", None, 1),
                            ("c002", 7, None), ("alone", 12345, 3), ("zero", 3, 0)]
    got = S.top_similar(spark.createDataFrame(rows, SCHEMA), k).collect()
    expected = plain(rows, k)
    assert {(r["campaign"], r["rank"]): (r["other"], r["similarity"]) for r in got} == expected
    assert len(got) == len(expected)


def test_dense_vectors_without_rare_dimensions(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", d, rng.randint(1, 9)) for c in range(40) for d in range(6)]
    got = S.top_similar(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert {(r["campaign"], r["rank"]): (r["other"], r["similarity"]) for r in got} == plain(rows, 3)


def test_a_dimension_that_all_share_makes_no_pairs(spark):
    rows = groups(240, 9)
    v = S._vectors(spark.createDataFrame(rows, SCHEMA), "campaign", "dimension", "weight")
    split = S._split(v, 3)
    assert split.where("d = -1 AND prefix").count() == 0
    assert S.partners(split, v).count() <= 240 * 5


@pytest.mark.parametrize("limit", ["0", "10m"])
@pytest.mark.parametrize("direct", [0, 1000])
def test_small_arrays_and_many_tasks(spark, monkeypatch, limit, direct):
    monkeypatch.setattr(S, "PART", 4)
    monkeypatch.setattr(S, "MEETINGS", 300)
    monkeypatch.setattr(S, "DIRECT", direct)
    rows = groups(60, 5)
    spark.conf.set("bidlake.broadcast.maxBytes", limit)
    try:
        got = S.top_similar(spark.createDataFrame(rows, SCHEMA), 4).collect()
    finally:
        spark.conf.unset("bidlake.broadcast.maxBytes")
    assert {(r["campaign"], r["rank"]): (r["other"], r["similarity"]) for r in got} == plain(rows, 4)


def test_pairs_are_not_shuffled(spark):
    top = S.top_similar(spark.createDataFrame(groups(60, 2, common=False), SCHEMA), 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan
    assert not re.search(r"hashpartitioning\(c#\d+, o#", plan)
    assert "Exchange" not in plan.split("posexplode")[0]  # nor anything else made of them


def test_empty_and_wrong_k(spark):
    assert S.top_similar(spark.createDataFrame([], SCHEMA), 3).collect() == []
    with pytest.raises(ValueError):
        S.top_similar(spark.createDataFrame([], SCHEMA), 0)


def shuffled_on_disk(spark):
    """Bytes of shuffles in Spark's local folders."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    total = 0
    for d in env.blockManager().diskBlockManager().localDirs():
        for f in glob.glob(f"{d.getPath()}/*/shuffle_*"):
            try:
                total += os.path.getsize(f)
            except OSError:  # it went meanwhile
                pass
    return total


@pytest.mark.parametrize("direct, part, limit", [(1000, 1024, "0"), (1000, 4, "10m"), (0, 4, "0")])
def test_rounds_equal_all_pairs(spark, monkeypatch, direct, part, limit):
    for name, value in {"PART": part, "DIRECT": direct, "ROUND": 1500, "PER_WEIGHT": 0}.items():
        monkeypatch.setattr(S, name, value)
    rounds = []
    monkeypatch.setattr(S, "write_parquet", lambda df, path, mode: (
        rounds.append(mode), files.write_parquet(df, path, mode)))
    rows = groups(60, 6)
    spark.conf.set("bidlake.broadcast.maxBytes", limit)
    try:
        got = S.top_similar(spark.createDataFrame(rows, SCHEMA), 4).collect()
    finally:
        spark.conf.unset("bidlake.broadcast.maxBytes")
    expected = plain(rows, 4)
    assert {(r["campaign"], r["rank"]): (r["other"], r["similarity"]) for r in got} == expected
    assert len(got) == len(expected)
    assert rounds.count("append") >= 3


def test_a_round_leaves_no_exchange_on_disk(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"c{c:03}", d, rng.randint(1, 50)) for c in range(300) for d in rng.sample(range(60), 40)]
    weights = spark.createDataFrame(rows, SCHEMA)
    for name, value in {"DIRECT": 10**6, "ROUND": 1, "PER_WEIGHT": 40}.items():
        monkeypatch.setattr(S, name, value, raising=False)
    start, left = shuffled_on_disk(spark), []

    def written(df, path, mode):
        files.write_parquet(df, path, mode)
        until = time.time() + 10  # files go in the background
        while shuffled_on_disk(spark) > start + 100_000 and time.time() < until:
            time.sleep(0.1)
        left.append(shuffled_on_disk(spark) - start)

    monkeypatch.setattr(S, "write_parquet", written, raising=False)
    got = S.top_similar(weights, 3).collect()
    left.append(shuffled_on_disk(spark) - start)
    assert {(r["campaign"], r["rank"]): (r["other"], r["similarity"]) for r in got} == plain(rows, 3)
    assert max(left) <= 100_000
    assert len(left) == 7
