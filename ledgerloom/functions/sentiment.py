"""Sentiment of a text by a lexicon and rules of context, as array functions.

The rules are those published for the VADER scorer: boosters and dampeners up to three words before, negation within three words, words in
capitals, the contrast word, exclamation and question marks. Lexicons of any size are looked up in place: words lie in buckets by
their CRC-32, so a lookup is a hash and a search in a few words, texts aren't shuffled, and everything stays in the JVM.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published weights.
BOOST, CAPITALS, NEGATION = 0.293, 0.733, -0.74
DAMPING = (1.0, 0.95, 0.9)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
NEVER_SO = (1.25, 1.25)
EXCLAMATION, EXCLAMATIONS_MOST = 0.292, 4
QUESTION, QUESTIONS, QUESTIONS_MANY = 0.18, 3, 0.96
NORMAL = 15.0
# The published words that make the next ones stronger or weaker, and that negate.
STRONGER = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply enormous enormously entirely especially exceptional "
    "exceptionally extreme extremely fabulously fully greatly hella highly hugely incredible incredibly intensely major majorly more most "
    "particularly purely quite really remarkably so substantially thoroughly total totally tremendous tremendously unbelievably unusually "
    "utter utterly very"
).split()
WEAKER = "almost barely hardly less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat".split()
NEGATING = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never none nope nor not "
    "nothing nowhere oughtnt shant shouldnt wasnt werent without wont wouldnt rarely seldom despite"
).split()


@dataclass(frozen=True)
class Rules:
    """Which words the rules are about."""

    boosters: dict[str, float] = field(default_factory=lambda: dict.fromkeys(STRONGER, BOOST) | dict.fromkeys(WEAKER, -BOOST))
    negations: tuple[str, ...] = tuple(NEGATING)
    contrast: str = "but"


def lookup(words: dict[str, float]) -> Callable[[Column], Column]:
    """A column function from a word to its number, or null."""
    n = max(1, len(words) // 2)
    buckets: list[dict] = [{} for _ in range(n)]
    for word, value in words.items():
        buckets[zlib.crc32(word.encode()) % n][word] = float(value)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,double>>")  # a constant: folded once
    return lambda word: F.try_element_at(F.get(table, (F.crc32(word) % n).cast("int")), word)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(clean: Column) -> Column:
    """Words of a cleaned text without marks around them; those of one or two characters keep theirs."""
    bare = lambda w: bound(F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", ""), lambda s: F.when(F.length(s) > 2, s).otherwise(w))
    return F.transform(F.filter(F.split(clean, " "), lambda w: w != ""), bare)


def _in_context(t: Column, i: Column, words: Column, mixed: Column) -> Column:
    """The valence of word t, number i, after the three words before it."""
    zero = F.lit(0.0)
    low = lambda back: F.coalesce(F.get(words, i - back)["low"], F.lit(""))
    negates = lambda back: F.coalesce(F.get(words, i - back)["negates"], F.lit(False))
    so = lambda back: low(back).isin("so", "this")

    def after(back: int) -> Callable[[Column], Column]:
        before = F.get(words, i - back)

        def body(v: Column) -> Column:
            sign = F.when(v < 0, -1.0).otherwise(1.0)
            loud = F.when(before["upper"] & mixed, F.when(v > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(zero)
            boost = F.when(before["boost"].isNull(), zero).otherwise((before["boost"] * sign + loud) * DAMPING[back - 1])
            if back == 1:
                turned = F.when(negates(1), NEGATION)
            else:
                never = (low(back) == "never") & (so(1) if back == 2 else so(2) | so(1))
                doubt = (low(back) == "without") & ((low(1) == "doubt") if back == 2 else (low(2) == "doubt") | (low(1) == "doubt"))
                turned = F.when(never, NEVER_SO[back - 2]).when(doubt, 1.0).when(negates(back), NEGATION)
            neutral = before.isNotNull() & before["valence"].isNull()
            return F.when(neutral, (v + boost) * turned.otherwise(1.0)).otherwise(v)

        return body

    own = t["valence"] + F.when(t["upper"] & mixed, F.when(t["valence"] > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(zero)
    found = bound(bound(bound(own, after(1)), after(2)), after(3))
    return F.when(t["valence"].isNull() | t["boost"].isNotNull(), zero).otherwise(found)


def with_compound(articles: DataFrame, clean: Column, lexicon: dict[str, float], rules: Rules | None = None) -> DataFrame:
    """articles with compound, the normalised score in (-1, 1) of a cleaned text; 0 without a word of the lexicon."""
    rules = rules or Rules()
    valence, boost = lookup({w.lower(): v for w, v in lexicon.items()}), lookup(rules.boosters)
    negates = lookup(dict.fromkeys(rules.negations, 1.0))

    def described(w: Column) -> Column:
        return bound(
            F.lower(w),
            lambda low: F.struct(
                low.alias("low"),
                ((w == F.upper(w)) & (w != low)).alias("upper"),
                valence(low).alias("valence"),
                boost(low).alias("boost"),
                negates(low).isNotNull().alias("negates"),
            ),
        )

    words, at = F.col("__words"), F.col("__at")
    upper = F.size(F.filter(words, lambda x: x["upper"]))
    rows = articles.withColumn("__clean", F.coalesce(clean, F.lit(""))).withColumn("__words", F.transform(_words(F.col("__clean")), described))
    rows = rows.withColumn("__mixed", (upper > 0) & (upper < F.size(words)))
    rows = rows.withColumn("__at", F.array_position(F.transform(words, lambda x: x["low"]), rules.contrast) - 1)  # -1: not there
    single = F.transform(words, lambda t, i: _in_context(t, i, words, F.col("__mixed")))
    weighed = F.transform(
        single,
        lambda v, i: F.when(at < 0, v).when(i < at, v * BEFORE_CONTRAST).when(i > at, v * AFTER_CONTRAST).otherwise(v),
    )
    count = lambda mark: F.length("__clean") - F.length(F.replace(F.col("__clean"), F.lit(mark), F.lit("")))
    questions = F.when(count("?") > QUESTIONS, QUESTIONS_MANY).when(count("?") > 1, count("?") * QUESTION).otherwise(0.0)
    marks = F.least(count("!"), F.lit(EXCLAMATIONS_MOST)) * EXCLAMATION + questions
    rows = rows.withColumn("__sum", F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x)).withColumn("__marks", marks)
    s = F.col("__sum") + F.when(F.col("__sum") > 0, F.col("__marks")).when(F.col("__sum") < 0, -F.col("__marks")).otherwise(0.0)
    return rows.withColumn("compound", bound(s, lambda x: x / F.sqrt(x * x + NORMAL))).drop("__clean", "__words", "__mixed", "__at", "__sum", "__marks")
