from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from laminar.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    return ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, with clashing extra columns."""
    ship(spark)

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        docs = spark.createDataFrame(full, SCHEMA)
        for extra in ("th", "h", "n", "fp", "p", "score", "size", "copies", "pos", "component", "doc", "i", "t", "__h", "__i", "__k", "__s", "__t", "tkey", "row", "all"):
            docs = docs.withColumn(extra, F.lit("x"))
        return docs

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "null id here with some words"), (4, "same text twice over and over"), (4, "same text twice over and over"), (5, "same text twice over and over"), (6, "word " * 30000), (7, "x" * 200000)]
