"""News: union of sources, de-duplication, ticker mentions and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import clean_text, keyword, lexicon_score, upper_each


def ranked_by_source(articles: DataFrame, ranks: DataFrame) -> DataFrame:
    """All articles with source_rank, the place of their source in ranks (source, source_rank; one row a source, few); null for a
    source that is not there or null. One scan, where the articles of all sources lie in one table."""
    return articles.join(F.broadcast(ranks) if ranks.limit(10_001).count() <= 10_000 else ranks, "source", "left")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of the sources with source_rank, the place of their source; duplicates stay."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s)
    return out


def first_of_each(articles: DataFrame) -> DataFrame:
    """Of articles with one text (by MD5 of its bytes) the first by seq, which is unique. Digests and numbers alone are aggregated,
    by hash and within tasks first, so a text repeated very often is no hot key; texts meet only the numbers that go."""
    marked = articles.select(F.coalesce(F.md5("text"), F.lit("")).alias("__digest"), F.col("seq").alias("__seq"))  # null texts are one text
    first = marked.groupBy("__digest").agg(F.min("__seq").alias("__first"), F.max("__seq").alias("__last")).where("__first < __last")
    gone = marked.join(first.drop("__last"), "__digest").where("__seq > __first").select("__seq")
    return articles.join(gone, articles["seq"] == gone["__seq"], "left_anti")


def mentions(articles: DataFrame, tickers: list[str]) -> DataFrame:
    """articles x tickers whose keyword is a substring of the text, any case; tickers are a list of bounded length, so
    they are matched in place, without a join."""
    text = upper_each(F.col("text"))
    found = F.filter(F.array(*[F.lit(t) for t in tickers]), lambda t: F.contains(text, keyword(t)))
    return articles.withColumn("ticker", F.explode(found))


#: Bytes of keywords and tickers that one automaton holds at most; more of them are matched in several passes.
AUTOMATON_BYTES = 16 << 20


class Automaton:
    """Keywords as one trie with failure links: a text is read once, whatever the number of keywords. States are numbered; a
    state's edges, its link, and the keywords that end in it, directly or by links, are lists by number."""

    def __init__(self, keywords: list[str]) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.empty = [i for i, word in enumerate(keywords) if not word]
        for i, word in enumerate(keywords):
            at = 0
            for c in word:
                if c not in self.edges[at]:
                    self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    self.ends.append([])
                at = self.edges[at][c]
            if word:
                self.ends[at].append(i)
        self.link = [0] * len(self.edges)
        todo = list(self.edges[0].values())
        for at in todo:  # by depth, as it grows
            for c, child in self.edges[at].items():
                up = self.link[at]
                while up and c not in self.edges[up]:
                    up = self.link[up]
                self.link[child] = self.edges[up].get(c, 0)
                self.ends[child] = self.ends[child] + self.ends[self.link[child]]
                todo.append(child)
        self.steps = [dict(e) for e in self.edges]  # with those by links as they come up

    def _step(self, at: int, c: str) -> int:
        """The state after a character that a state has no edge for."""
        up = at
        while up and c not in self.edges[up]:
            up = self.link[up]
        self.steps[at][c] = self.edges[up].get(c, 0)
        return self.steps[at][c]

    def found(self, text: str) -> set[int]:
        """Numbers of the keywords that are substrings of the text."""
        out, at, steps, ends = set(self.empty), 0, self.steps, self.ends
        for c in text:
            after = steps[at].get(c)
            at = self._step(at, c) if after is None else after
            if ends[at]:
                out.update(ends[at])
        return out


def _matched(kept: Broadcast) -> Callable[[Column], Column]:
    """A column function from a text in upper case to the tickers that it mentions; kept: pairs of keyword and ticker."""

    @F.arrow_udf("array<string>")
    def matched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[str]] = {}
        for word, ticker in kept.value:
            known.setdefault(word, []).append(ticker)
        words = list(known)
        automaton = Automaton(words)
        for batch in texts:
            rows = [sorted(t for k in automaton.found(x) for t in known[words[k]]) if x is not None else [] for x in batch.to_pylist()]
            yield pa.array(rows, pa.list_(pa.string()))

    return matched


def mentions_of_many(articles: DataFrame, tickers: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """mentions for a table of tickers of any length (column ticker): one reading of each text against an automaton of all keywords,
    which is broadcast up to so many bytes and dealt over several passes beyond. A null text mentions none."""
    spark = articles.sparkSession
    names = tickers.select("ticker").where("ticker IS NOT NULL").distinct()
    total = names.agg(F.sum(F.octet_length("ticker") + F.lit(8))).first()[0] or 0
    passes = max(1, -(-total // most_bytes))
    out = None
    for i in range(passes):
        mine = names.where(F.pmod(F.xxhash64("ticker"), F.lit(passes)) == i) if passes > 1 else names
        kept = spark.sparkContext.broadcast([(r.word, r.ticker) for r in mine.select(keyword(F.col("ticker")).alias("word"), "ticker").collect()])

        rows = articles.withColumn("ticker", F.explode(_matched(kept)(upper_each(F.col("text")))))
        out = rows if out is None else out.unionByName(rows)
    return out


def scored(articles: DataFrame, lexicon: dict[str, float], model: Callable[[Column], Column] | None = None) -> DataFrame:
    """articles with the score of their cleaned text and its confidence, 0.5 for the lexicon. model: the net score of a cleaned
    text as a column, say a Pandas UDF; where it gives null the lexicon scores, at the confidence 1.0 of a model all the same."""
    clean = clean_text(F.col("text"))
    by_words = lexicon_score(clean, lexicon)
    score = by_words if model is None else F.coalesce(model(clean), by_words)
    return articles.withColumn("score", score).withColumn("confidence", F.lit(0.5 if model is None else 1.0))


def scored_mentions(articles: DataFrame, tickers: list[str], lexicon: dict[str, float], model: Callable[[Column], Column] | None = None) -> DataFrame:
    """articles x mentioned tickers with score; articles that mention none are dropped before they are scored, and the
    others are scored once each."""
    text = upper_each(F.col("text"))
    found = F.filter(F.array(*[F.lit(t) for t in tickers]), lambda t: F.contains(text, keyword(t)))
    some = articles.withColumn("tickers", found).where(F.size("tickers") > 0)
    return scored(some, lexicon, model).withColumn("ticker", F.explode("tickers")).drop("tickers")


#: Words of a lexicon that are broadcast at once; more of them are looked up in several passes.
WORDS_MOST = 1 << 18


def scored_by_table(articles: DataFrame, lexicon: DataFrame, most_words: int = WORDS_MOST) -> DataFrame:
    """seq, score of the cleaned text by a lexicon table of any size (token, valence); of equal tokens the smallest valence counts.
    Words meet the lexicon, which is broadcast, where their text is read, and are added up at once: a number for each article is all that
    is kept or shuffled. Sums are in hundredths, so their order doesn't matter."""
    valence = lexicon.groupBy(F.lower("token").alias("word")).agg(F.min(F.round(F.col("valence") * 100).cast("long")).alias("v"))
    words = articles.select("seq", F.explode_outer(F.split(F.lower(clean_text(F.col("text"))), " ")).alias("word"))
    passes = max(1, -(-valence.count() // most_words))
    found = None
    for i in range(passes):
        mine = valence.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == i) if passes > 1 else valence
        rows = words.join(F.broadcast(mine), "word", "left").groupBy("seq").agg(F.sum("v").alias("c"))
        found = rows if found is None else found.unionByName(rows)
    sums = found.groupBy("seq").agg(F.sum("c").alias("c")) if passes > 1 else found
    s = F.coalesce("c", F.lit(0)) / F.lit(100.0)
    return sums.select("seq", (s / F.sqrt(s * s + 15.0)).alias("score"))


def top_articles(articles: DataFrame, k: int = 10) -> DataFrame:
    """The k newest dated-or-not articles of each ticker: by published, newest first, undated last, then seq."""
    by = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("published"), "seq")
    return articles.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k)
