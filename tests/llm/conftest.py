from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

EDGE_ROWS = [
    (None, "a text without an id", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, " \n\t ", "fr"),
    (4, "same words here", "en"),
    (4, "same words here", "en"),
    (5, "x" * 300_000, "en"),
    (6, "mot " * 60_000, "fr"),
    (7, "日本語 é ß İ 😀 \x1c\x85 end", None),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    docs = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string")
    for name in ("t", "fp", "kept", "n_words", "component_id", "score", "spans", "ids", "good", "key", "base", "assign"):
        docs = docs.withColumn(name, F.lit("other"))
    return docs


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
