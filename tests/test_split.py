from pyspark.sql import functions as F

from bidlake.operators.split import exact_split, hash_split, label_shift, shift_value


def test_hash_split_disjoint_covering_reproducible(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in hash_split(df, ["k"], 7).collect()}
    b = {r.k: r.split for r in hash_split(df, ["k"], 7).collect()}
    assert a == b and len(a) == 2000
    assert set(a.values()) == {"train", "validation", "test"}
    c = {r.k: r.split for r in hash_split(df, ["k"], 8).collect()}
    assert a != c


def test_exact_split_sizes(spark):
    for n in (1, 7, 10, 101, 1000):
        df = spark.range(n).withColumnRenamed("id", "k")
        out = exact_split(df, ["k"], 3, partitions=4)
        counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
        a, b = (n * 60) // 100, (n * 80) // 100
        assert counts.get("train", 0) == a
        assert counts.get("validation", 0) == b - a
        assert counts.get("test", 0) == n - b
        assert out.select("k").distinct().count() == n


def test_exact_split_equals_positions_in_hash_order(spark):
    """Selection with brackets of few rows, and copies of a key at a cut."""
    import hashlib

    keys = list(range(700)) + [7] * 300
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    out = exact_split(df, ["k"], 3, few=20)
    assert out.columns == ["k", "i", "split"] and out.count() == 1000
    order = sorted(keys, key=lambda k: (hashlib.md5(f"3|={k}".encode()).hexdigest(), k))
    expected = [(k, "train" if p < 600 else "validation" if p < 800 else "test")
                for p, k in enumerate(order)]
    assert sorted((r.k, r.split) for r in out.collect()) == sorted(expected)
    assert exact_split(df.limit(0), ["k"], 3).collect() == []


def test_label_shift_constant(spark):
    df = spark.createDataFrame([("1.0",), ("2.5",)], "biddingprice string")
    got = [r.biddingprice for r in label_shift(df, "biddingprice", 0.0002).collect()]
    assert abs(got[0] - 0.9996) < 1e-12 and abs(got[1] - 2.4996) < 1e-12
    u = shift_value(42)
    assert 0.0 <= u <= 0.0008 and u == shift_value(42)
    shifted = label_shift(df, "biddingprice", u).select(F.col("biddingprice")).collect()
    deltas = {round(s.biddingprice - float(o.biddingprice), 12) for s, o in zip(shifted, df.collect())}
    assert len(deltas) == 1


def test_hash_tells_near_doubles_and_nulls_apart(spark):
    from bidlake.operators.split import hash_text

    rows = [(0.0021, "a", None), (0.0024, "a", None), (1e17, "a", None), (0.0021, None, "a")]
    df = spark.createDataFrame(rows, "x double, p string, q string")
    hashes = [r.h for r in df.select(hash_text(["x", "p", "q"], 1).alias("h")).collect()]
    assert len(set(hashes)) == 4
