import os
import sys

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(sf):
    """(doc_id, text) of the smallest documents table."""
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]


LONG = "very long text without an end " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank and very long texts, a repeated row, columns with names that operators use."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 7),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n ", "xx", "a", 4),
        (5, LONG, "en", None, len(LONG)),
        (6, "one two three four five six seven", "en", "a", 7),
        (6, "one two three four five six seven", "en", "a", 7),
        (None, "one two three four five six seven", "de", "b", 7),
        (7, "漢字 😀 ñandú\x1cx\x85y", "fr", "b", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_lines", "n_words", "spans", "hits", "key", "n", "score", "again", "ids", "start"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
