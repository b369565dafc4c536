"""Second-wave analytics: ranges, risk and signal quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.market import with_span_before

DAY = 86400

# Half-life of a score in hours, weights of sources by rank, fewest articles of a confident score.
HALF_LIFE_HOURS, CREDIBILITY, CONFIDENT = 4, (1.0, 0.7, 0.4), 5


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def range_extremes(series: DataFrame, days: int = 364) -> DataFrame:
    """key, d, high_52w, low_52w: extremes of value over the days before, this one included. series: (key, d, value)."""
    rows = with_span_before(series.select("key", "d", "value"), "d", f"{days} DAYS", f"{days} days")
    by = Window.partitionBy("key", "__bucket").orderBy(epoch(F.col("d"))).rangeBetween(-days * DAY, 0)
    rows = rows.withColumn("high_52w", F.max("value").over(by)).withColumn("low_52w", F.min("value").over(by))
    return rows.where("NOT __carried").select("key", "d", "value", "high_52w", "low_52w")


def recent_change(scores: DataFrame, hours: int = 2) -> DataFrame:
    """id, fell, rose: each score less the highest and less the lowest of its ticker in the hours before. scores: (id, ticker, ts,
    score)."""
    rows = with_span_before(scores.select("id", "ticker", "ts", "score"), "ts", f"{hours} HOURS", "1 day")
    by = Window.partitionBy("ticker", "__bucket").orderBy(epoch(F.col("ts"))).rangeBetween(-hours * 3600, 0)
    rows = rows.withColumn("high", F.max("score").over(by)).withColumn("low", F.min("score").over(by)).where("NOT __carried")
    return rows.select("id", (F.col("score") - F.col("high")).alias("fell"), (F.col("score") - F.col("low")).alias("rose"))


def daily_returns(bars: DataFrame) -> DataFrame:
    """ticker, bar_ts, ret: close over the day's before, less 1."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("bar_ts"))
    return bars.withColumn("before", before).where("before > 0").select("ticker", "bar_ts", (F.col("close") / F.col("before") - 1).alias("ret"))


def decayed_sentiment(scores: DataFrame, anchor: DataFrame) -> DataFrame:
    """ticker, n_articles, score_e6, low_confidence: mean of scores weighted by 2^(-age / half-life) and credibility,
    in millionths. scores: (ticker, ts, score, credibility); anchor: one row with column now."""
    hours = (epoch(F.col("now")) - epoch(F.col("ts"))) / 3600.0
    weight = F.pow(F.lit(2.0), -hours / HALF_LIFE_HOURS) * F.col("credibility")
    # integer sums: the order of rows doesn't matter
    w = F.floor(weight * 1e9 + 0.5)
    ws = F.floor(weight * F.col("score") * 1e9 + 0.5)
    rows = scores.crossJoin(F.broadcast(anchor)).select("ticker", w.alias("w"), ws.alias("ws"))
    sums = rows.groupBy("ticker").agg(F.count("*").alias("n_articles"), F.sum("w").alias("w"), F.sum("ws").alias("ws"))
    return sums.select(
        "ticker",
        "n_articles",
        F.floor(F.when(F.col("w") > 0, F.col("ws") / F.when(F.col("w") > 0, F.col("w")) * 1e6 + 0.5)).alias("score_e6"),
        (F.col("n_articles") < CONFIDENT).alias("low_confidence"),
    )


def outcome(signal: Column, before: Column, after: Column) -> Column:
    """CORRECT or WRONG: a buy is right if the price rose, a sale if it fell, a hold if it moved 2 % at most."""
    moved = F.abs(after - before) * 100 <= before * 2
    right = F.when(signal == "BUY", after > before).when(signal == "SELL", after < before).otherwise(moved)
    return F.when(after.isNull(), F.lit(None)).when(right, "CORRECT").otherwise("WRONG")


def top_cosine(rows: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows (id, v) most similar to the one row of query (q): cosine to 6 decimals, then id."""
    dot = lambda a, b: F.aggregate(
        F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    norm = lambda a: F.sqrt(dot(a, a))
    sim = dot("v", "q") / (norm("v") * norm("q"))
    return rows.crossJoin(F.broadcast(query)).select("id", (F.floor(sim * 1e6 + 0.5) / 1e6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)
