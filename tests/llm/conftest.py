from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id string, spans string, v double, tokens string, sig string, n string, count string, key string"


def document(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "x", "y", "z", 0.5, "t", "g", "7", "c", "k")


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (id, text) or (id, text, lang), with more columns, of clashing names."""
    return lambda rows: spark.createDataFrame([document(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and very long texts, repeated rows, ties."""
    long = "lorem ipsum dolor " * 40_000
    return make(
        [
            (1, None),
            (2, ""),
            (3, " \n\t "),
            (4, long),
            (5, "one two"),
            (5, "one two"),
            (None, "one two"),
            (None, None),
            (6, "ünï 漢字 \U0001f600 x"),
            (7, "a" * 300_000),
            (8, "1" * 300_000),
            (9, "@" * 50_000),
            (10, "one two", None),
        ],
    )


@pytest.fixture(scope="session")
def none(make):
    return make([])


def words(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
