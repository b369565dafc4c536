"""Queries on news and sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars, sentiment
from ledgerloom.operators import market, news
from ledgerloom.plans.monitor import sentiment_scores
from ledgerloom.sources import tables as src

API_KEYS = ("key-a", "key-b", "key-c")
SOURCES = tuple(f"src{i}" for i in range(20))


def articles_union(spark: SparkSession, d: str) -> DataFrame:
    """Every article with the place of its source in the fixed order; in one scan, as all sources lie in one table."""
    ranks = spark.createDataFrame([(s, i) for i, s in enumerate(SOURCES)], "source string, source_rank int")
    return news.ranked_by_source(src.articles(spark, d), ranks).select("seq", "source_rank")


def dedupe_md5(spark: SparkSession, d: str) -> DataFrame:
    return news.first_of_each(src.articles(spark, d)).select("seq", F.md5("text").alias("digest"))


def articles_per_source(spark: SparkSession, d: str) -> DataFrame:
    return news.first_of_each(src.articles(spark, d)).groupBy("source").agg(F.count("*").alias("n"))


def rss_recent(spark: SparkSession, d: str) -> DataFrame:
    """Undated articles, and those of the two hours before January 30th."""
    since = F.lit("2024-01-29 22:00:00").cast("timestamp_ntz")
    return src.articles(spark, d).where(F.col("published").isNull() | (F.col("published") >= since)).select("seq", "published")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return news.first_of_each(src.articles(spark, d)).select("seq", scalars.clean_text(F.col("text")).alias("clean"))


def mention_match(spark: SparkSession, d: str) -> DataFrame:
    return news.mentions(news.first_of_each(src.articles(spark, d)), list(src.KEYWORDS)).select("seq", "ticker")


def mention_match_many(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of some thousand tickers: the different words of the benchmark's texts, of five characters or more, with an exchange."""
    words = src.read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("word"))
    tickers = words.select(F.concat(F.upper("word"), F.lit(".NS")).alias("ticker")).distinct()
    return news.mentions_of_many(news.first_of_each(src.articles(spark, d)), tickers).select("seq", "ticker")


def news_top10_per_ticker(spark: SparkSession, d: str) -> DataFrame:
    rows = news.mentions(src.articles(spark, d), [k for k in src.KEYWORDS if not k.startswith("^")])
    return news.top_articles(rows).select("ticker", "seq", "n")


def key_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Which key asks for which traded ticker: in the tickers' order, indices left out, .NS removed."""
    traded = src.ticks(spark, d).select("ticker").distinct().where("NOT startswith(ticker, '^')")
    asked = traded.withColumn("idx", F.row_number().over(Window.orderBy("ticker")) - 1)  # one row a ticker
    return asked.select(F.replace("ticker", F.lit(".NS"), F.lit("")).alias("query"), src.pick(API_KEYS, F.pmod("idx", F.lit(len(API_KEYS)))).alias("api_key"))


def article_text(spark: SparkSession, d: str) -> DataFrame:
    """Title and description of conversations' turns as articles: a null one is the word None."""
    title = F.when(F.col("turn") % 3 != 0, F.col("role"))
    description = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return src.read(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.coalesce(title, F.lit("None")), F.lit(". "), F.coalesce(description, F.lit("None"))).alias("article"),
    )


def lexicon_score(spark: SparkSession, d: str) -> DataFrame:
    rows = news.scored(news.first_of_each(src.articles(spark, d)), src.LEXICON)
    return rows.select("seq", scalars.half_up(F.col("score"), 9).alias("score"), "confidence")


def lexicon_table_score(spark: SparkSession, d: str) -> DataFrame:
    """lexicon_score by a table of words instead of a literal map."""
    lexicon = spark.createDataFrame(list(src.LEXICON.items()), "token string, valence double")
    rows = news.scored_by_table(news.first_of_each(src.articles(spark, d)), lexicon)
    return rows.select("seq", scalars.half_up(F.col("score"), 9).alias("score"))


#: Words of the invented prose in the parts of a lexicon and of the rules' words.
RULE_LEXICON = {"thing": 1.5, "ering": -1.5, "oning": -0.8, "tion": 1.1, "eau": 0.9, "der": -0.4, "la": 0.3, "that": -0.6, "was": 0.7, "ing": 2.1, "ed": -1.9}
RULES = sentiment.Rules({"re": sentiment.BOOST, "en": sentiment.BOOST, "er": -sentiment.BOOST, "a": -sentiment.BOOST}, ("un", "is", "no", "nicht", "never"), "ou")


def vader_compound(spark: SparkSession, d: str) -> DataFrame:
    """Compound score of every different article by lexicon and rules of context."""
    rows = sentiment.with_compound(news.first_of_each(src.articles(spark, d)), scalars.clean_text(F.col("text")), RULE_LEXICON, RULES)
    return rows.select("seq", scalars.half_up(F.col("compound"), 6).alias("compound"))


def softmax_net_score(spark: SparkSession, d: str) -> DataFrame:
    """The first three components of each embedding as logits."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return src.read(spark, d, "embeddings").select("vec_id", scalars.half_up(scalars.softmax_net(at(0), at(1), at(2)), 9).alias("net"))


def sentiment_band(spark: SparkSession, d: str) -> DataFrame:
    return sentiment_scores(spark, d).select("id", scalars.sentiment_band(F.col("score")).alias("band"))


def lang_filter(spark: SparkSession, d: str) -> DataFrame:
    return src.read(spark, d, "documents").where(F.col("lang").isin("en", "hi")).select("doc_id", "lang")


def strip_html(spark: SparkSession, d: str) -> DataFrame:
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    return src.read(spark, d, "pages").select("page_id", text.alias("text"))


def dedupe_url(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each address without its query and fragment."""
    address = F.regexp_replace("url", "[?#].*$", "")
    return src.read(spark, d, "pages").groupBy(address.alias("address")).agg(F.min("page_id").alias("page_id"))


def chat_last10(spark: SparkSession, d: str) -> DataFrame:
    rows = src.read(spark, d, "conversations").select("conv_id", "turn", "role")
    return market.latest_k(rows, "conv_id", 10, "turn").select("conv_id", "turn", "role")


QUERIES = {
    f.__name__: f
    for f in (
        articles_union,
        dedupe_md5,
        articles_per_source,
        rss_recent,
        clean_text,
        mention_match,
        mention_match_many,
        news_top10_per_ticker,
        key_round_robin,
        article_text,
        lexicon_score,
        lexicon_table_score,
        vader_compound,
        softmax_net_score,
        sentiment_band,
        lang_filter,
        strip_html,
        dedupe_url,
        chat_last10,
    )
}

_LOGITS = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings"
_OF = lambda words: "MAP {" + ", ".join(f"'{w}': {float(v)}::DOUBLE" for w, v in words.items()) + "}"


def _after(back: int, v: str) -> str:
    """The rules for the word so many before word i, on the valence v."""
    word = lambda k: f"ws[CASE WHEN i > {k} THEN i - {k} END]"
    p = word(back)
    low = lambda k: f"coalesce({word(k)}.low, '')"
    so = lambda k: f"{low(k)} IN ('so', 'this')"
    if back == 1:
        turned = f"CASE WHEN {p}.negates THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END"
    else:
        never = f"{low(back)} = 'never' AND ({so(1) if back == 2 else so(2) + ' OR ' + so(1)})"
        doubt = f"{low(back)} = 'without' AND ({low(1)} = 'doubt'" + ("" if back == 2 else f" OR {low(2)} = 'doubt'") + ")"
        turned = f"CASE WHEN {never} THEN 1.25::DOUBLE WHEN {doubt} THEN 1.0::DOUBLE WHEN {p}.negates THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END"
    loud = f"CASE WHEN {p}.up AND mixed THEN CASE WHEN v > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END ELSE 0.0::DOUBLE END"
    damping = {1: 1.0, 2: 0.95, 3: 0.9}[back]
    boost = f"CASE WHEN {p}.b IS NULL THEN 0.0::DOUBLE ELSE ({p}.b * CASE WHEN v < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END + {loud}) * {damping}::DOUBLE END"
    return f"SELECT * REPLACE (CASE WHEN {p}.low IS NOT NULL AND {p}.val IS NULL THEN (v + {boost}) * {turned} ELSE v END AS v) FROM ({v})"


_VADER = rf"""WITH w AS (
  SELECT seq, clean, list_transform(list_filter(string_split(clean, ' '), lambda x: x <> ''),
    lambda x: CASE WHEN length(regexp_replace(x, '^[.,!?]+|[.,!?]+$', '', 'g')) > 2 THEN regexp_replace(x, '^[.,!?]+|[.,!?]+$', '', 'g') ELSE x END) AS ww FROM v_clean),
t AS (
  SELECT seq, clean, list_transform(ww, lambda x: {{'low': lower(x), 'up': x = upper(x) AND x <> lower(x), 'val': {_OF(RULE_LEXICON)}[lower(x)],
    'b': {_OF(RULES.boosters)}[lower(x)], 'negates': lower(x) IN {RULES.negations}}}) AS ws FROM w),
m AS (SELECT seq, clean, ws, len(list_filter(ws, lambda x: x.up)) > 0 AND len(list_filter(ws, lambda x: x.up)) < len(ws) AS mixed,
  list_position(list_transform(ws, lambda x: x.low), '{RULES.contrast}') AS cut FROM t),
e AS (SELECT seq, clean, ws, mixed, cut, unnest(generate_series(1, len(ws))) AS i FROM m),
h AS (SELECT *, ws[i].val + CASE WHEN ws[i].up AND mixed THEN CASE WHEN ws[i].val > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END ELSE 0.0::DOUBLE END AS v FROM e WHERE ws[i].val IS NOT NULL AND ws[i].b IS NULL),
r AS ({_after(3, _after(2, _after(1, "SELECT * FROM h")))}),
x AS (SELECT seq, i, CASE WHEN cut IS NULL OR cut = 0 THEN v WHEN i < cut THEN v * 0.5 WHEN i > cut THEN v * 1.5 ELSE v END AS v FROM r),
s AS (SELECT seq, list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY i)), lambda a, b: a + b) AS total FROM x GROUP BY seq),
q AS (SELECT w.seq, coalesce(total, 0.0) AS total, least(len(clean) - len(replace(clean, '!', '')), 4) * 0.292::DOUBLE +
  CASE WHEN len(clean) - len(replace(clean, '?', '')) > 3 THEN 0.96::DOUBLE WHEN len(clean) - len(replace(clean, '?', '')) > 1
  THEN (len(clean) - len(replace(clean, '?', ''))) * 0.18::DOUBLE ELSE 0.0::DOUBLE END AS marks FROM w LEFT JOIN s ON s.seq = w.seq),
z AS (SELECT seq, total + CASE WHEN total > 0 THEN marks WHEN total < 0 THEN -marks ELSE 0.0 END AS s FROM q)
SELECT seq, floor(s / sqrt(s * s + 15.0::DOUBLE) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS compound FROM z"""

SQL = {
    "vader_compound": _VADER,
    "articles_union": "SELECT seq, CASE WHEN regexp_full_match(source, 'src1?[0-9]') THEN CAST(substr(source, 4) AS INT) END AS source_rank FROM v_articles",
    "dedupe_md5": "SELECT seq, md5(text) AS digest FROM v_dedup",
    "articles_per_source": "SELECT source, count(*) AS n FROM v_dedup GROUP BY source",
    "rss_recent": "SELECT seq, published FROM v_articles WHERE published IS NULL OR published >= TIMESTAMP '2024-01-29 22:00:00'",
    "clean_text": "SELECT seq, clean FROM v_clean",
    "mention_match": "SELECT a.seq, k.ticker FROM v_dedup a JOIN v_keywords k ON contains(upper(a.text), k.keyword)",
    "mention_match_many": (
        "SELECT a.seq, k.word || '.NS' AS ticker FROM v_dedup a JOIN (SELECT DISTINCT upper(word) AS word FROM (SELECT unnest(regexp_extract_all(text, "
        "'[A-Za-z]{5,}')) AS word FROM benchmark)) k ON contains(upper(a.text), k.word)"
    ),
    "news_top10_per_ticker": (
        "SELECT k.ticker, a.seq, CAST(row_number() OVER (PARTITION BY k.ticker ORDER BY a.published DESC NULLS LAST, a.seq) AS INT) AS n "
        "FROM v_articles a JOIN v_keywords k ON contains(upper(a.text), k.keyword) WHERE NOT starts_with(k.ticker, '^') QUALIFY n <= 10"
    ),
    "key_round_robin": (
        "SELECT replace(ticker, '.NS', '') AS query, (['key-a', 'key-b', 'key-c'])[(row_number() OVER (ORDER BY ticker) - 1) % 3 + 1] AS api_key "
        "FROM (SELECT DISTINCT ticker FROM v_ticks WHERE NOT starts_with(ticker, '^'))"
    ),
    "article_text": (
        "SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 <> 0 THEN role END, 'None') || '. ' || coalesce(CASE WHEN turn % 2 = 0 THEN "
        "text END, 'None') AS article FROM conversations"
    ),
    "lexicon_score": "SELECT seq, floor(score * 1000000000.0::DOUBLE + 0.5) / 1000000000.0::DOUBLE AS score, 0.5::DOUBLE AS confidence FROM v_scored",
    "lexicon_table_score": "SELECT seq, floor(score * 1000000000.0::DOUBLE + 0.5) / 1000000000.0::DOUBLE AS score FROM v_scored",
    "softmax_net_score": (
        f"SELECT vec_id, floor((exp(a - m) - exp(b - m)) / (exp(a - m) + exp(b - m) + exp(c - m)) * 1000000000.0::DOUBLE + 0.5) / "
        f"1000000000.0::DOUBLE AS net FROM (SELECT *, greatest(a, b, c) AS m FROM ({_LOGITS}))"
    ),
    "sentiment_band": (
        "SELECT id, CASE WHEN score >= 0.6 THEN 'BULLISH' WHEN score >= 0.2 THEN 'MILDLY_BULLISH' WHEN score >= -0.2 THEN 'NEUTRAL' WHEN "
        "score >= -0.6 THEN 'MILDLY_BEARISH' ELSE 'BEARISH' END AS band FROM v_sentiment"
    ),
    "lang_filter": "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'hi')",
    "strip_html": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS text FROM pages",
    "dedupe_url": "SELECT regexp_replace(url, '[?#].*$', '') AS address, min(page_id) AS page_id FROM pages GROUP BY 1",
    "chat_last10": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10",
}
