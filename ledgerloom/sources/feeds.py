"""What collectors bring, read from files in the shapes that providers send: search responses, RSS feeds and price frames.

Collectors write whole responses, one file each; Spark reads any number of them. Articles get text, source and published;
a null title or description is the word None, as in the advisor's own texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEARCH = "status string, articles array<struct<title string, description string, publishedAt string>>"
ITEM = "title string, description string, pubDate string"
#: Forms of an item's time once the name of the day is cut.
ITEM_TIMES = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx")


def article_text(title: Column, description: Column, absent: str = "None") -> Column:
    return F.concat(F.coalesce(title, F.lit(absent)), F.lit(". "), F.coalesce(description, F.lit(absent)))


def search_articles(spark: SparkSession, path: str, source: str, most: int = 10) -> DataFrame:
    """text, source, published: the first articles of each search response; responses that aren't ok or can't be read give none."""
    responses = spark.read.schema(SEARCH).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("status = 'ok'")
    rows = responses.select(F.explode(F.slice("articles", 1, most)).alias("a")).select("a.*")
    at = F.col("publishedAt").try_cast("timestamp")
    return rows.select(article_text(F.col("title"), F.col("description")).alias("text"), F.lit(source).alias("source"), at.alias("published"))


def rss_articles(spark: SparkSession, path: str, source: str) -> DataFrame:
    """text, source, published: the items of RSS feeds; what an item lacks is empty, and a time that can't be read is null."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    bare = F.regexp_replace("pubDate", "^[A-Za-z]+, *", "")
    at = F.coalesce(*[F.try_to_timestamp(bare, F.lit(form)) for form in ITEM_TIMES])
    text = article_text(F.col("title"), F.col("description"), absent="")
    return items.select(text.alias("text"), F.lit(source).alias("source"), at.alias("published"))


def recent(articles: DataFrame, now: str, hours: int = 2) -> DataFrame:
    """Articles of the hours before an instant, and undated ones."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return articles.where(F.col("published").isNull() | (F.col("published") >= since))


def price_frames(spark: SparkSession, path: str) -> DataFrame:
    """ticker, timestamp, open, high, low, close, volume from CSV frames with a header (Datetime, Open, High, Low, Close, Volume),
    in folders ticker=...; a time without a zone is UTC, and rows without a time or a close are left out."""
    frames = spark.read.schema("Datetime string, Open double, High double, Low double, Close double, Volume double, ticker string")
    rows = frames.option("header", True).csv(path).withColumn("timestamp", F.col("Datetime").try_cast("timestamp"))
    rows = rows.where("timestamp IS NOT NULL AND Close IS NOT NULL")
    return rows.select("ticker", "timestamp", *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")])
