import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TEXT = "doc_id bigint, text string"


@pytest.fixture
def texts(spark):
    """A table of texts with columns that clash with the operators' own names."""
    def make(rows):
        from pyspark.sql import functions as F

        return (spark.createDataFrame(rows, TEXT).withColumn("n_words", F.lit("x"))
                .withColumn("name", F.lit(1)).withColumn("score", F.lit("s"))
                .withColumn("part", F.lit(2)).withColumn("spans", F.lit(None).cast("int")))
    return make


@pytest.fixture(scope="session")
def documents(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]
