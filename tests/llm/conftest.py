import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns whose names clash with results."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 0, "x", 9),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 0, "x", 9),
        (2, None, "en", "a", 1, None, None),
        (3, "", None, None, 2, "y", 1),
        (4, " \t\n ", "de", "b", 3, "y", 1),
        (5, "word " * 30000, "de", "b", 4, "z", 2),
        (None, "the quick brown fox jumps over the lazy dog", None, "c", None, None, None),
        (6, "été über niño 12,5 — \U0001f600 ok", "fr", "c", 5, "z", 3),
        (7, "één", "fr", "\U0001f600", 6, "z", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, fingerprint string, component_id int")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
