"""Rows that every operator must take."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with inner names."""
    long_text = " ".join(f"word{i % 977} and then" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a", 1, "x", 5),
        (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a", 1, "x", 5),
        (2, None, None, None, None, None, None),
        (3, "", "en", "", 0, "", 0),
        (None, "no id here but some words", "en", "a", 5, "y", 1),
        (4, long_text, "en", "b", len(long_text), "z", 2),
        (5, " \n\t ", "de", "b", 4, None, 3),
        (6, "x" * 50_000, "de", "c", 50_000, "w", 4),
        (7, "Ünïcödé wörter 漢字 🎉 und mehr davon", None, "c", 30, "v", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, t string, i long")
