import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample(spark):
    """(doc_id, text) of the smallest documents table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns, separators of all kinds."""
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(30000))
    rows = [(1, None, "a", "en", 1, "x"), (2, "", None, None, 2, "y"), (3, " \n\t ", "a", "en", 3, None),
            (4, "one", "b", "fr", 4, "x"), (5, long, "b", "en", 5, "x"), (6, long + " tail", "c", "en", 6, "x"),
            (7, "Same words Here again and again until the window is long enough to count as thirteen words", "a", "en", 7, "x"),
            (7, "Same words Here again and again until the window is long enough to count as thirteen words", "a", "en", 7, "x"),
            (8, "same words here again and again until the window is long enough to count as thirteen words", "a", "de", 8, "x"),
            (9, "é ü\x0bŁ \x1c x\r\ny " * 8, "a", "de", 9, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words long, fp string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
