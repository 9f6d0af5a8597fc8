import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne", "sa", "ti", "vo") for b in ("", "ra", "nd", "x,")]


@pytest.fixture
def prose():
    """Texts of random words, the same in every run."""

    def make(seed, n):
        draw = random.Random(seed)
        return [draw.choice(WORDS) for _ in range(n)]

    return make


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows, and
    columns whose names operators use themselves."""
    rows = [
        (1, "one two three four five six", "en", "a", 1, 0.5),
        (1, "one two three four five six", "en", "a", 1, 0.5),
        (2, "one two  three\tfour\nfive six", "en", "a", 1, 0.5),
        (2, "another text under the same id", "en", None, 1, 0.5),
        (3, "", "de", "b", 1, 0.5),
        (4, None, "de", "b", None, None),
        (5, " \t\r\n\v\f ", None, None, 1, 0.5),
        (None, "no id here at all", None, "c", 1, 0.5),
        (None, "no id here at all", None, "c", 1, 0.5),
        (6, "long " * 60_000, "fr", "c", 1, 0.5),
        (7, "é ß x " * 30, "de", "ü", 1, 0.5),
        (8, "x" * 50_000, "fr", "", 1, 0.5),
        (9, "12345 !!! ???", "en", "b", 1, 0.5),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n long, score double"
    )


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
