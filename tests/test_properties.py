"""Property tests: operators against plain-Python brute force on random small frames."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidlake.operators.encoding import CATEGORY, CODE, FEATURE, ordinal_fit
from bidlake.operators.latest import latest_per_key, latest_within_keys
from bidlake.operators.sequence import running_totals

rows_st = st.lists(
    st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 6)), st.integers(0, 10_000)),
    min_size=1, max_size=40, unique_by=lambda r: r[2])


def brute_latest(rows):
    best = {}
    for k, t, i in rows:
        cur = best.get(k)
        key = (t is not None, t if t is not None else 0, i)
        if cur is None or key > cur[0]:
            best[k] = (key, i)
    return {k: v[1] for k, v in best.items()}


@settings(max_examples=10, deadline=None)
@given(rows_st)
def test_latest_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k int, t int, id int")
    got = {r.k: r.id for r in latest_per_key(df, "k", "t", "id").collect()}
    assert got == brute_latest(rows)
    # Same answer through the audience path, both orders (broadcast and shuffled).
    keys = spark.createDataFrame([(0,), (2,), (4,)], "k int")
    expect = {k: v for k, v in brute_latest(rows).items() if k in (0, 2, 4)}
    for bound in (None, 0):
        got = {r.k: r.id for r in latest_within_keys(df, keys, "k", "t", "id", bound).collect()}
        assert got == expect


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", "z", None]), st.sampled_from(["p", "q"])),
                min_size=1, max_size=30))
def test_encode_decode_round_trip(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "o int, a string, b string")
    enc = ordinal_fit(df, ["a", "b"], "o", partitions=2)
    coded = enc.transform(df)
    back = coded
    for c in ("a", "b"):
        m = enc.mapping.where(F.col(FEATURE) == c).select(
            F.col(CODE).alias(c), F.col(CATEGORY).alias(f"{c}_back"))
        back = back.join(m, c, "left")
    got = {(r.o, r.a_back, r.b_back) for r in back.collect()}
    assert got == {(i, a, b) for i, (a, b) in enumerate(pairs)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2"]), st.integers(-5, 5)),
                min_size=1, max_size=50))
def test_running_totals_match_prefix_sums(spark, vals):
    df = spark.createDataFrame([(g, i, v) for i, (g, v) in enumerate(vals)],
                               "g string, o int, v int")
    out = running_totals(df, ["o"], ["v"], ["g"], partitions=3, with_total=True).collect()
    acc, tot = {}, {}
    for g, v in vals:
        tot[g] = tot.get(g, 0) + v
    expect = {}
    for i, (g, v) in enumerate(vals):
        acc[g] = acc.get(g, 0) + v
        expect[i] = (acc[g], tot[g])
    assert {r.o: (r.v_cum, r.v_total) for r in out} == expect
