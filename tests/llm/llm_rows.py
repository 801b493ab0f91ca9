"""Rows for the tests of this folder (fixtures, imported by name)."""

import pytest


@pytest.fixture
def docs(spark):
    """documents rows with clashing extra columns, nulls, repeats, empty and long texts."""
    def make(rows):
        return spark.createDataFrame([(i, t, lang, "src", 0, "x", 1) for i, t, lang in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, words string, score int")
    return make


ODD_TEXTS = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "one two three"), (5, "one two three"), (None, "x y z x y z"),
             (6, "word " * 20000), (7, "é" * 700), (8, "<|endoftext|> ▁ #$% 10.0.0.1"), (9, "1" * 3000), (10, "▁\U0001F600 字 \x00")]


@pytest.fixture
def odd_docs(docs):
    return docs([(i, t, None if k % 3 else "en") for k, (i, t) in enumerate(ODD_TEXTS)])
