"""The pipeline, stage by stage, against plain versions; SQL can't express its scores."""

import pytest
from brute import boilerplate_cut, near_duplicates, without_phrases
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from bidlake.llm.common import stage
from bidlake.llm.toxicity import op4_toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = {"input": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = out[name] = stage(function(spark, docs, sf_small), "test")
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order_and_columns(stages):
    names = list(stages)
    assert names == ["input", "toxicity", "line_dedup", "ngram_join", "decontaminate", "packing"]
    for name in names[1:-1]:
        assert stages[name].columns == stages["input"].columns
        assert [f.dataType for f in stages[name].schema] == [
            f.dataType for f in stages["input"].schema]
    assert corpus_pipeline.ORACLE_SQL is None
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_toxic_documents_go(spark, sf_small, stages):
    toxic = {r["doc_id"] for r in op4_toxicity(spark, sf_small).where("predicted = 1").collect()}
    before = texts(stages["input"])
    assert texts(stages["toxicity"]) == {k: t for k, t in before.items() if k not in toxic}


def test_lines(stages):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in stages["toxicity"].collect()]
    assert texts(stages["line_dedup"]) == boilerplate_cut(rows)
    assert stages["line_dedup"].where(F.col("n_chars") != F.length("text")).isEmpty()


def test_copied_texts_outlive_the_line_stage(spark, sf_small):
    """A third of one source is one text, and 6 of 50 documents of another: stage 2 leaves their
    lines, but takes a line that distinct documents share; stage 3 keeps one of each."""
    schema = spark.read.parquet(f"{sf_small}/documents.parquet").schema
    words = "one two three four five six seven eight"
    rows = [(k, f"copied text {words}\nits second line {words}" + " " * (k % 2), "en", "a", 0)
            for k in range(30)]
    rows += [(100 + k, f"menu\nown{k} a{k} b{k} c{k} d{k} e{k}", "en", "a", 0) for k in range(60)]
    rows += [(200 + k, f"other copied {words}" if k < 6 else f"x{k} y{k} z{k} u{k} v{k} w{k}",
              "en", "b", 0) for k in range(50)]
    out = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, schema), sf_small)
    want = {i: t.removeprefix("menu\n") for i, t, *_ in rows}
    assert texts(out) == want
    kept = texts(corpus_pipeline.drop_near_duplicates(spark, stage(out, "test"), sf_small))
    assert kept == {i: t for i, t in want.items() if not (0 < i < 30 or 200 < i < 206)}


def test_near_duplicates_go(stages):
    before = texts(stages["line_dedup"])
    kept = {i for i, (_, c) in near_duplicates(before.items()).items() if i == c}
    assert texts(stages["ngram_join"]) == {k: t for k, t in before.items() if k in kept}


def test_benchmark_words_go(spark, sf_small, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    before = texts(stages["ngram_join"])
    after = texts(stages["decontaminate"])
    assert after == {k: without_phrases(t, items) for k, t in before.items()}
    assert stages["decontaminate"].where(F.col("n_chars") != F.length("text")).isEmpty()


def test_everything_left_is_packed(stages):
    left = texts(stages["decontaminate"])
    total = stages["packing"].groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.first("doc_tokens").alias("of")).collect()
    assert {r["doc_id"] for r in total} == set(left)
    assert all(r["n"] == r["of"] for r in total)


def test_no_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("false")
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_small), "test")
    assert docs.count() == 0


def test_nulls_and_extra_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(20)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (10**9, "", None, None, 0), (10**9, "", None, None, 0),
         (10**9 + 1, "é " * 60_000, "xx", "src0", 1)], docs.schema)
    docs = docs.unionByName(odd)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_small), "test")
    got = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(
        F.sum("length").alias("n")).collect()}
    assert got[None] == 1 and got[10**9] == 2
