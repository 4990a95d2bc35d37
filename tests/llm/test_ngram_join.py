import random

import pytest
from brute import near_duplicates as brute

from bidlake.llm.components import connected_components
from bidlake.llm.ngram_join import near_duplicates, one_of_each, op3_ngram_join


def found(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in near_duplicates(df, **more).collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
    return " ".join(words)


def corpus():
    rng = random.Random(5)
    base = [f"w{rng.randrange(1000)}" for _ in range(120)]
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(k, edited(rng, base, rng.randrange(0, 9))) for k in range(40)]
    docs += [(100 + k, passage + " " + edited(rng, base[:40], 40)) for k in range(20)]
    docs += [(200 + k, " ".join(base)) for k in range(15)]
    docs += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE  two"),
             (305, "one two three"), (306, "x " * 30_000), (307, "X " * 29_000)]
    # a chain: each links to the next only
    line = [f"c{k}" for k in range(300)]
    docs += [(400 + k, " ".join(line[12 * k:12 * k + 100])) for k in range(12)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("chunk,heavy", [(512, 1 / 200), (3, 1 / 20)])
def test_matches_brute_force(spark, texts, chunk, heavy):
    docs = corpus()
    assert found(texts(docs), chunk=chunk, heavy_share=heavy) == brute(docs)


def test_whole_table(spark, documents, sf_small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in op3_ngram_join(spark, sf_small).collect()}
    assert got == brute(documents)


def test_repeated_and_missing_ids(spark, texts):
    text = "a b c d e f g h i j"
    rows = near_duplicates(texts([(7, text), (7, text), (3, text), (None, text), (None, "")]))
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows.collect()), key=str) == sorted(
        [(7, 3), (7, 3), (3, 3), (None, 3), (None, None)], key=str)


def test_one_of_each_keeps_columns(spark, texts):
    docs = texts(corpus())
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute(corpus()).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_empty_table(spark, texts):
    assert found(texts([])) == {}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(9, 9)]
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint"))
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert got.count() == len(want)
