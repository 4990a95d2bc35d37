import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bidlake.llm.warc_revisit import PERMITTED, canonical_url, resolve_revisits

SCHEMA = ("record_id bigint, url string, captured timestamp, kind string, status int, "
          "headers map<string,string>, payload string, outcome string, source int, slice int")


def at(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def make(spark, rows):
    return spark.createDataFrame([(i, u, at(t), k, s, h, p, "x", 1, 2)
                                  for i, u, t, k, s, h, p in rows], SCHEMA)


def full(i, u, t, h, p="body", status=200):
    return (i, u, t, "response", status, h, p)


def visit(i, u, t, h):
    return (i, u, t, "revisit", 304, h, None)


def brute(rows):
    """Outcome and source of each revisit; URLs are canonical already."""
    out = {}
    for i, u, t, kind, _, h, _ in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (h or {}).items()}
        before = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == u and u
                  and None not in (t, r[2]) and (r[2], r[0]) < (t, i)]
        if not before:
            out[i] = ("no_earlier_response", None)
            continue
        last = max(before, key=lambda r: (r[2], r[0]))
        theirs = {k.lower(): v for k, v in (last[5] or {}).items()}
        name = "etag" if h.get("etag") is not None else "last-modified"
        if h.get(name) is None:
            out[i] = ("no_validator", None)
        elif h[name].removeprefix("W/") == (theirs.get(name) or "").removeprefix("W/"):
            out[i] = ("resolved", last[0])
        else:
            out[i] = ("validator_mismatch", None)
    return out


def found(df, **more):
    return {r["record_id"]: (r["outcome"], r["refers_to"])
            for r in resolve_revisits(df, **more).collect()}


@pytest.mark.parametrize("slices", [64, 4])
def test_matches_brute_force(spark, slices):
    """One URL holds half of all captures; times tie."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        u = "a.org" if i % 2 else f"b.org/{i % 7}"
        t = rng.randrange(0, 60)
        h = rng.choice([{"ETag": '"1"'}, {"etag": 'W/"1"'}, {"ETag": '"2"'}, {}, None,
                        {"Last-Modified": "x"}, {"ETag": None, "last-modified": "x"}])
        if rng.random() < 0.4:
            rows.append(full(i, u, t, h, status=rng.choice([200, 200, 404])))
        else:
            rows.append(visit(i, u, t, h))
    rows += [visit(900, None, 5, {"etag": "1"}), visit(901, "a.org", None, {"etag": "1"}),
             full(902, "a.org", None, {"etag": '"1"'}), full(903, None, 0, {"etag": '"1"'})]
    df = make(spark, [(i, u and "http://" + u, *r) for i, u, *r in rows])
    assert found(df, slices=slices) == brute(rows)


def test_headers_merge_and_body(spark):
    rows = [full(1, "http://a.org/x", 0, {"Content-Type": "text/html", "ETag": '"1"',
                                          "Date": "old", "Content-Length": "4"}, "b" * 200_000),
            visit(2, "HTTPS://A.org:443/x/#top", 9, {"etag": 'W/"1"', "DATE": "new",
                                                     "Content-Length": "0", "X-Own": "1"})]
    row = resolve_revisits(make(spark, rows)).first()
    assert row["headers"] == {"content-type": "text/html", "etag": 'W/"1"', "date": "new",
                              "content-length": "4"}
    assert (row["refers_to"], row["status"], row["payload"]) == (1, 200, "b" * 200_000)
    assert set(PERMITTED) & {"content-length", "content-type"} == set()


@pytest.mark.parametrize("url,want", [
    ("http://A.org", "a.org"), ("https://a.org:443/", "a.org"), ("http://a.org:81/", "a.org:81"),
    ("http://u@a.org/x//?b=2&a=1&utm_source=z#f", "a.org/x?a=1&b=2"),
    ("http://a.org?gclid=1", "a.org"), ("nothing", None), (None, None)])
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(canonical_url(F.col("u"))).first()[0] == want


def test_empty_and_repeated(spark):
    assert found(make(spark, [])) == {}
    one = visit(5, "http://a.org", 3, {"etag": "1"})
    got = resolve_revisits(make(spark, [one, one, full(1, "http://a.org", 0, {"etag": "1"})]))
    assert [(r["record_id"], r["refers_to"]) for r in got.collect()] == [(5, 1), (5, 1)]


def test_repeated_responses_count_once(spark):
    """Each revisit has one row, however often its response is stored."""
    same = full(1, "http://a.org", 0, {"etag": "1"}, "b")
    rows = [same, same, same, full(1, "http://a.org", 0, {"etag": "1"}, "a"),
            visit(5, "http://a.org", 3, {"etag": "1"}), visit(6, "http://a.org", 4, {"etag": "2"}),
            visit(None, "http://a.org", 5, {"etag": "1"}), visit(7, None, 5, {"etag": "1"})]
    got = [(r["record_id"], r["refers_to"], r["payload"])
           for r in resolve_revisits(make(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(5, 1, "a"), (6, None, None), (None, 1, "a"), (7, None, None)], key=str)


def test_responses_without_id_are_not_used(spark):
    rows = [full(None, "http://a.org", 2, {"etag": "1"}), full(1, "http://a.org", 0, {"etag": "1"}),
            visit(5, "http://a.org", 3, {"etag": "1"}), visit(None, None, None, None)]
    assert found(make(spark, rows)) == {5: ("resolved", 1), None: ("no_earlier_response", None)}


def test_clashing_names(spark):
    rows = [full(1, "http://a.org", 0, {"etag": "1"}), visit(5, "http://a.org", 3, {"etag": "1"})]
    clash = make(spark, rows).withColumn("_key", F.lit("x")).withColumn("refers_to", F.lit(9))
    assert found(clash) == {5: ("resolved", 1)}
