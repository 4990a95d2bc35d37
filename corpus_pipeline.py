"""A training corpus from ``documents``: five stages, each written and read again.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last
one returns the packed pieces.

1. toxicity: documents that score 0.7 or more go. The model is fitted on this stage's own
   documents and the labelled training rows.
2. line_dedup: lines that stand in more than a tenth of a source's documents go from them;
   documents of a source with the same lines count once, as whole copies are the next stage's
   work; a document keeps its row, even with an empty text.
3. ngram_join: of documents linked by a Jaccard similarity of 0.75 or more over five-word
   shingles the smallest doc_id stays.
4. decontaminate: words of benchmark windows go from the texts.
5. packing: sequences of at most 1024 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from bidlake.llm.common import small_batches, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    names = docs.columns
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels), keep_text=True)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(names)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    names = docs.columns
    out = line_dedup.drop_boilerplate_lines(docs, "source", "text", stats="_lines",
                                            copies_once=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)
                          ).select(names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return ngram_join.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    return decontaminate.removal_text(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", cut_benchmark),
    ("packing", pack),
]

#: SQL can't express scores of a fitted model, so tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
