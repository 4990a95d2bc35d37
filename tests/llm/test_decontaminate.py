import random

import pytest
from brute import contamination, without_phrases

from bidlake.llm.decontaminate import find_contamination, op2_decontaminate, removal_text

ITEMS = "item_id bigint, text string"
BASE = "one two three four five six seven eight nine ten eleven twelve"


def found(spark, docs, items, **more):
    got = find_contamination(docs, spark.createDataFrame(items, ITEMS), ["doc_id"], **more)
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()}


DOCS = [
    (1, f"x {BASE} y"), (2, BASE.upper().replace(" ", "--")), (3, None), (4, ""), (5, "!!"),
    (6, "one two three four five six seven eight nine"), (7, "short item here"),
    (8, "a short item, here a short item here"), (9, "être été un"), (10, BASE + " " + BASE),
    (11, "filler " * 30_000 + BASE), (12, "one"), (12, f"x {BASE} y"),
]
TEST = [(1, BASE), (2, "short item"), (3, None), (4, ""), (5, "été un"), (2, "here a"),
        (10, BASE + " thirteen")]


@pytest.mark.parametrize("pack", [2_000_000, 5])
def test_matches_brute_force(spark, texts, pack):
    assert found(spark, texts(DOCS[:-1]), TEST, pack_words=pack) == contamination(DOCS[:-1], TEST)


def test_random_words(spark, texts):
    rng = random.Random(3)
    words = "a b c d e f".split()
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for k in range(8)]
    docs = [(k, " ".join(rng.choices(words + ["zz"], k=rng.randint(0, 60)))) for k in range(200)]
    assert found(spark, texts(docs), items, window=4) == contamination(docs, items, 4)


def test_whole_table(spark, documents, sf_small):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet")
             .select("item_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"])
           for r in op2_decontaminate(spark, sf_small).collect()}
    assert got == {i: (w, h, len(n)) for i, (w, h, n) in contamination(documents, items).items()}


def test_removal(spark, texts):
    docs = texts(DOCS).withColumnRenamed("name", "n_chars")
    rows = removal_text(docs, spark.createDataFrame(TEST, ITEMS)).collect()
    assert rows[0].asDict().keys() == set(docs.columns)
    got = sorted((r["doc_id"], r["text"] or "") for r in rows)
    assert got == sorted((i, without_phrases(t, TEST)) for i, t in DOCS)


def test_empty_tables(spark, texts):
    assert found(spark, texts([]), TEST) == {}
    assert found(spark, texts([(1, BASE)]), []) == {1: (12, 0, [])}
