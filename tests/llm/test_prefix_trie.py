"""The trie against a plain version that walks all prefixes of all conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def identity(role, text):
    role, text = role or "", text or ""
    said = f"{len(role.encode())}:{role}{text}".encode()
    return hashlib.sha256(said).hexdigest()[:32], len(re.findall(r"[^\x20\x09-\x0D]+", text))


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), *identity(role, text)))
    own = {c: [(h, w) for _, h, w in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []

    def walk(p):
        below = [walk(c) for c in children[p]]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(members[p]) - 1) * (p[-1][1] if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None,
                    len(members[p]), len(below), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if whole:
        walk(())
    return sorted(out, key=str)


def ours(spark, rows, rebuild=True, **sizes):
    table = (spark.createDataFrame(rows, SCHEMA).withColumn("base", F.lit("x"))
             .withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3)))
    seqs = P.rebuilt(table) if rebuild else P.sequences(table)
    got = P.with_digests(P.prefix_trie(seqs, **sizes))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                           "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def talks(n, seed, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < hot:
            texts = ["hello there"] + ["hot turn"] * rng.randint(0, 3)
        else:
            texts = [rng.choice(["a", "b c", "d  e f", ""]) for _ in range(rng.randint(0, 6))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(texts)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"most_rows": 1}, {"most_rows": 3}, {"most_turns": 9}])
def test_equals_plain_whatever_the_segments(spark, sizes):
    rows = talks(160, 11)
    assert ours(spark, rows, **sizes) == plain(rows)


def test_one_conversation_for_all_spans_many_segments(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(150) for t in range(3)]
    assert ours(spark, rows, rebuild=False, most_rows=2) == plain(rows, rebuild=False)


def test_nulls_ties_repeats_negative_ids_and_long_conversations(spark):
    rows = ([(1, None, None, None), (1, 0, "user", "x y"), (1, 0, "user", "x y"), (1, 0, "a", "b"),
             (None, 0, "user", "lost"), (-7, 1, "user", "minus"), (-3, None, "user", "minus"),
             (0, 1, None, "base"), (0, 2, "user", ""), (7, 0, "", ""), (9, 3, "user", "w " * 50_000)]
            + [(21, t, "user", f"word {t % 3}") for t in range(500)]
            + [(22, t, "user", f"word {t % 3}") for t in range(480)])
    for sizes in ({}, {"most_rows": 1}):
        assert ours(spark, rows, **sizes) == plain(rows)


def test_empty_and_turnless(spark):
    assert ours(spark, []) == [] == plain([])
    # crc32("2") % 4 is 1: one own turn goes, and there is no conversation 0 to take one from
    rows = [(2, 0, "user", "only")]
    assert zlib.crc32(b"2") % 4 == 1
    assert ours(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_extents_equal_a_scan():
    rng = np.random.default_rng(5)
    lcp = rng.integers(0, 4, 200)
    lcp[0] = -1
    table = P.sparse_table(lcp)
    at, depth = np.repeat(np.arange(200), 5), np.tile(np.arange(5), 200)
    right, left = P.right_extents(table, at, depth), P.left_extents(table, at, depth)
    for i, d, r, l in zip(at, depth, right, left, strict=True):
        a = b = i
        while b + 1 < 200 and lcp[b + 1] >= d:
            b += 1
        while a > 0 and lcp[a] >= d:
            a -= 1
        assert (r, l) == (b, a)
    first, last = np.minimum(at, at[::-1]), np.maximum(at, at[::-1])
    assert [lcp[a:b + 1].min() for a, b in zip(first, last, strict=True)] == \
        P.range_minimum(table, first, last).tolist()


def test_query(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, P.op11_prefix_trie(spark, sf_small).collect()), key=str)
    assert got == plain(rows)
