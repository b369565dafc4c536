"""Rules of context: golden sentences by the published rules, worked out by hand, and lexicons of any size."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import sentiment
from ledgerloom.functions.scalars import clean_text

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "handsome": 2.2, "funny": 1.9, "smart": 1.7, "uptight": -1.6}
norm = lambda s: s / math.sqrt(s * s + 15)
SENTENCES = [
    ("The book was good.", norm(1.9)),
    ("The book was bad.", norm(-2.5)),
    ("The book was not good.", norm(1.9 * -0.74)),
    ("At least it isnt a bad book.", norm(-2.5 * -0.74)),
    ("The book was very good.", norm(1.9 + 0.293)),
    ("The book was slightly bad.", norm(-2.5 + 0.293)),
    ("A very long good book", norm(1.9 + 0.293 * 0.95)),
    ("very long red good book", norm(1.9 + 0.293 * 0.9)),
    ("very long red old good book", norm(1.9)),
    ("never so good a book", norm((1.9 + 0.293) * 1.25)),
    ("without a doubt good", norm(1.9)),
    ("The book was GOOD", norm(1.9 + 0.733)),
    ("THE BOOK WAS GOOD", norm(1.9)),
    ("It was VERY bad", norm(-2.5 - 0.293 - 0.733)),
    ("good!!!", norm(1.9 + 3 * 0.292)),
    ("good!!!!!!", norm(1.9 + 4 * 0.292)),
    ("bad!", norm(-2.5 - 0.292)),
    ("good??", norm(1.9 + 2 * 0.18)),
    ("good?????", norm(1.9 + 0.96)),
    ("good?", norm(1.9)),
    ("good but bad", norm(1.9 * 0.5 - 2.5 * 1.5)),
    ("handsome, smart and funny.", norm(2.2 + 1.7 + 1.9)),
    ("not a very good book", norm((1.9 + 0.293) * -0.74)),
    ("great good", norm(3.1 + 1.9)),  # a word with a valence changes none after it
    ("nothing here!!", 0.0),
    ("", 0.0),
    (None, 0.0),
    ("http://good.com/bad x", 0.0),
]


def test_golden_sentences(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i long, text string")
    got = {r.i: r.compound for r in sentiment.with_compound(rows, clean_text(F.col("text")), LEXICON).collect()}
    for i, (text, want) in enumerate(SENTENCES):
        assert got[i] == pytest.approx(want, abs=1e-12), text


def test_a_lexicon_of_ten_thousand_words(spark):
    lexicon = {f"word{i}": (i % 9 - 4) / 2 for i in range(10_000)}
    rows = spark.createDataFrame([(i, f"x word{i} y") for i in range(10_000)], "i long, text string")
    found = sentiment.with_compound(rows, F.col("text"), lexicon)
    assert all(r.compound == pytest.approx(norm(lexicon[f"word{r.i}"]), abs=1e-12) for r in found.collect())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_columns_stay(spark):
    rows = spark.createDataFrame([(1, "good", "w")], "i long, text string, words string")
    assert sentiment.with_compound(rows, F.col("text"), LEXICON).columns == ["i", "text", "words", "compound"]
