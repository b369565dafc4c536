"""Mentions of many tickers: the automaton against substring tests, and its cost."""

from __future__ import annotations

import random
import time

import pytest

from ledgerloom.operators import news


@pytest.mark.parametrize("alphabet, n", [("AB", 60), ("ABCDEFGHIJ", 500)])
def test_automaton_finds_substrings(alphabet, n):
    r = random.Random(n)
    words = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 7))) for _ in range(n)]
    automaton = news.Automaton(words)
    for _ in range(200):
        text = "".join(r.choice(alphabet + " ") for _ in range(r.randrange(0, 80)))
        assert automaton.found(text) == {i for i, w in enumerate(words) if w in text}


@pytest.mark.parametrize("most", [news.AUTOMATON_BYTES, 60])
def test_same_as_the_short_list(spark, most):
    """One pass, and several; tickers of one keyword, an empty one, null texts, and a column that stays."""
    tickers = ["ITC.NS", "ITC.BO", "LT.NS", "^NSEI", ".NS", "RESULT", "lower.NS"]
    rows = [(1, "the itc result", "x"), (2, "nothing", "y"), (3, None, "z"), (4, "", "w"), (5, "^nsei Lower LT", "v"), (5, "^nsei Lower LT", "v")]
    articles = spark.createDataFrame(rows, "seq long, text string, more string")
    want = sorted((r.seq, r.text, r.more, r.ticker) for r in news.mentions(articles.where("text IS NOT NULL"), tickers).collect())
    table = spark.createDataFrame([(t,) for t in [*tickers, "ITC.NS", None]], "ticker string")
    got = news.mentions_of_many(articles, table, most)
    assert got.columns == ["seq", "text", "more", "ticker"]
    assert sorted(map(tuple, got.collect())) == want
    assert news.mentions_of_many(articles, table.limit(0)).count() == 0


def test_cost_hardly_grows_with_the_number_of_tickers():
    """833 times as many cost a few times as much: the automaton no longer fits the processor's cache."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randrange(5, 9)))
    words = [word() for _ in range(5000)]
    texts = [" ".join(word() for _ in range(300)) for _ in range(100)]

    def took(some):
        automaton = news.Automaton(some)
        began = time.process_time()
        for t in texts:
            automaton.found(t)
        return time.process_time() - began

    assert min(took(words) for _ in range(3)) < 8 * min(took(words[:6]) for _ in range(3))


def test_capitals_add_no_characters(spark):
    """A sharp s is no SS and a ligature no FI, as in the SQL's upper; what has one capital is found in any case."""
    texts = ["a schoßchen", "ﬁnance", "ẗ lẗ", "GROß \U0001f4c8", "ᾀ ﬁ", "schön été"]
    words = ["SSCHE", "FINANCE", "LT", "groß", "ᾈ", "SCHÖN", "étÉ"]
    articles = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    tickers = [f"{w}.NS" for w in words]
    want = [(3, "groß.NS"), (4, "ᾈ.NS"), (5, "SCHÖN.NS"), (5, "étÉ.NS")]
    table = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    for found in (news.mentions(articles, tickers), news.mentions_of_many(articles, table), news.scored_mentions(articles, tickers, {"a": 1.0})):
        assert sorted((r.seq, r.ticker) for r in found.collect()) == want
