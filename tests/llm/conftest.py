from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old tower by night"

ODD_DOCS = [
    (1, "Alpha beta gamma delta. " + SHARED + " and then they slept until morning came again", "en", "a", 5),
    (2, "Other words stand here first, " + SHARED + " but nobody was looking at all", "en", "a", 5),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (5, " \n\t ", "en", "a", 4),
    (6, "one two", "de", "b", 7),
    (6, "one two", "de", "b", 7),
    (None, "one two three", "de", "b", None),
    (None, None, None, None, None),
    (7, "naïve café ñandú É́ ！ <|endoftext|> It's 5 o'clock. " * 3, "fr", "b", 9),
    (8, "same line here\n" * 40, "en", "a", 1),
    (9, "x" * 5000 + " " + "word " * 3000, "en", "a", 1),
    (10, "same line here\n" * 40, "en", "a", 1),
    (11, SHARED.upper() + " " + SHARED, "en", "b", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(*r, 7, "x", 1.0, "k") for r in ODD_DOCS]
    extra = DOCS + ", n int, key string, score double, row string"
    return spark.createDataFrame(rows, extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
