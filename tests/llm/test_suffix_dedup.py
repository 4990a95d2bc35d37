import random

import numpy as np
from brute import without_repeats
from pyspark.sql import functions as F

from bidlake.llm import suffix_dedup
from bidlake.llm.suffix_dedup import (
    PrefixHash,
    op5_suffix_dedup,
    remove_repeats,
    suffix_mergesort,
)


def found(df):
    rows = remove_repeats(df).select(
        "doc_id", "n_bytes", "spans", F.sha2("kept", 256).alias("sha")).collect()
    return {r["doc_id"]: (r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]),
                          len(r["spans"]), r["sha"]) for r in rows}


def noise(rng, n):
    return "".join(rng.choices("abcdeé ", k=n))


def corpus():
    rng = random.Random(11)
    shared = [noise(rng, n) for n in (97, 99, 100, 101, 150, 400)]
    docs = []
    for k in range(60):
        parts = [noise(rng, rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), noise(rng, rng.randrange(0, 120))]
        docs.append((k, "".join(parts)))
    long = noise(rng, 600)
    docs += [(100 + k, long[:300] + noise(rng, 1) + long[300:]) for k in range(10)]
    docs += [(200, None), (201, ""), (202, "ab" * 400), (203, "ab" * 400), (204, "x" * 99),
             (205, "x" * 100), (206, "x" * 101), (207, noise(rng, 50_000)), (208, "abc" * 300)]
    rng.shuffle(docs)
    return docs


def test_matches_brute_force(spark, texts):
    docs = corpus()
    assert found(texts(docs)) == without_repeats(docs)


def test_hot_anchors(spark, texts, monkeypatch):
    """Windows of hot anchors are dealt one by one; the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    docs = corpus()
    got = suffix_dedup.compare_regions  # the limit is read in the worker, so set it there too

    def low(batches, parts):
        suffix_dedup.HOT = 1
        return got(batches, parts)

    monkeypatch.setattr(suffix_dedup, "compare_regions", low)
    assert found(texts(docs)) == without_repeats(docs)


def test_whole_table(spark, documents, sf_small):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in op5_suffix_dedup(spark, sf_small).collect()}
    assert got == without_repeats(documents)


def test_repeated_and_missing_ids(spark, texts):
    rows = remove_repeats(texts([(1, "a" * 150), (1, "a" * 150), (None, "b" * 120), (None, None),
                                 (0, "b" * 120)])).collect()
    got = sorted((str(r["doc_id"]), len(r["kept"])) for r in rows)
    first = without_repeats([(0, "b" * 120), (1, "a" * 150), (2, "a" * 150), (3, "b" * 120),
                             (4, None)])
    kept = sorted((i if i in "01" else "1" if i == "2" else "None", n - gone)
                  for i, (n, gone, _, _) in ((str(k), v) for k, v in first.items()))
    assert got == kept


def test_empty_table(spark, texts):
    assert found(texts([])) == {}


def test_slices_change_nothing(spark, texts, monkeypatch):
    whole = suffix_dedup.slice_regions
    rng = random.Random(4)
    raw = np.frombuffer((noise(rng, 900) * 2).encode(), np.uint8)
    offsets = np.array([0, 300, 300, 1100, len(raw)])
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 20)
    one = sorted(zip(*suffix_dedup.regions(raw, offsets)[:2], strict=True))
    monkeypatch.setattr(suffix_dedup, "SLICE", 70)
    many = sorted(zip(*suffix_dedup.regions(raw, offsets)[:2], strict=True))
    windows = [{s + k for s, c in x for k in range(c)} for x in (one, many)]
    assert windows[0] == windows[1] and whole is suffix_dedup.slice_regions
    docs = corpus()
    got = suffix_dedup.find_regions

    def small(batches, parts):
        suffix_dedup.SLICE = 70
        return got(batches, parts)

    monkeypatch.setattr(suffix_dedup, "find_regions", small)
    assert found(texts(docs)) == without_repeats(docs)


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 600).astype(np.uint8)
    starts = np.arange(480)
    groups = np.sort(rng.integers(0, 5, 480))
    order = suffix_mergesort(PrefixHash(raw), starts, groups)
    data = raw.tobytes()
    want = sorted(range(480), key=lambda k: (groups[k], data[k:k + 100], k))
    assert order.tolist() == want


def test_extension():
    text = PrefixHash(np.frombuffer(b"abcdeabcdfabcde" + b"z" * 20, np.uint8))
    a, b = np.array([0, 0, 1]), np.array([5, 10, 1])
    assert text.extension(a, b, 10).tolist() == [4, 5, 10]
