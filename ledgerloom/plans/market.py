"""Queries on market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import market, positions
from ledgerloom.sources import tables as src
from ledgerloom.sources.daily import FirstWins
from ledgerloom.streaming.streams import shared_folder


def live_price(spark: SparkSession, d: str) -> DataFrame:
    return market.live_price(src.ticks(spark, d))


def live_price_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Prices that live at noon of January 15th, by a time to live of an hour."""
    return market.fresh_price(src.ticks(spark, d), "2024-01-15 12:00:00", 3600)


def latest_price(spark: SparkSession, d: str) -> DataFrame:
    """Quotes exist for tickers of even numbers, one of them 0; the others take the last hourly close."""
    quotes = live_price(spark, d).select(
        "ticker",
        F.when(
            F.substring("ticker", 2, 9).cast("int") % 2 == 0,
            F.when(F.col("ticker") == "T4", 0.0).otherwise(F.col("price")),
        ).alias("quote"),
    )
    return market.latest_price(quotes, market.bars(src.ticks(spark, d), "1 hour"))


def _bars(interval: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return market.bars(src.ticks(spark, d), interval)

    return query


def ohlcv_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Days up to the 15th are stored with an open of 1; all days come in; stored ones stay as they are."""
    daily = market.bars(src.ticks(spark, d), "1 day")
    stored = daily.where(F.col("bar_ts") < F.lit("2024-01-16").cast("timestamp_ntz")).withColumn("open", F.lit(1.0))
    return market.insert_if_absent(stored, daily, ["ticker", "bar_ts"], "open")


def daily_insert_sink(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars by a table that takes batches once: three of them overlap, later ones with other prices, and one comes twice."""
    bars = market.bars(src.ticks(spark, d), "1 day").select("ticker", "bar_ts", "open", "close")
    table = FirstWins(spark, shared_folder(spark), "ticker string, bar_ts timestamp_ntz, open double, close double", ("ticker", "bar_ts"))
    day = F.dayofmonth("bar_ts")
    for batch, (first, last) in enumerate(((1, 12), (8, 20), (8, 20), (15, 31))):
        own = bars.where(day.between(first, last)).withColumn("close", F.col("close") + batch)
        table.write(own, min(batch, batch // 3 + 1), "open")
    return table.read()


def tracked_tickers(spark: SparkSession, d: str) -> DataFrame:
    return market.tracked_tickers(positions.average_cost(src.trades(spark, d)).where("quantity > 0"))


def tracked_tickers_default(spark: SparkSession, d: str) -> DataFrame:
    return market.tracked_tickers(positions.average_cost(src.trades(spark, d)).where("quantity < 0"))


def asof_price(spark: SparkSession, d: str) -> DataFrame:
    """The latest tick of the ticker at or before each trade."""
    ticks = src.ticks(spark, d).select("ticker", "ts", "price", "event_id")
    rows = src.trades(spark, d).select("id", "ticker", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return market.as_of(rows, ticks, ["ticker"], "ts", ["price"], "event_id", bucket="1 day")


def market_hours_ticks(spark: SparkSession, d: str) -> DataFrame:
    return src.ticks(spark, d).where(scalars.market_open(F.col("ts"))).select("event_id", "ticker", "ts", "price")


def market_hours_minute(spark: SparkSession, d: str) -> DataFrame:
    return src.ticks(spark, d).select("event_id", scalars.market_open_minute(F.col("ts")).alias("open"))


def latest_k_bars(spark: SparkSession, d: str) -> DataFrame:
    hourly = market.bars(src.ticks(spark, d), "1 hour")
    return market.latest_k(hourly, "ticker", 21, "bar_ts").select("ticker", "bar_ts", "close", "n")


def chart_buffer(spark: SparkSession, d: str) -> DataFrame:
    rows = src.ticks(spark, d).select("ticker", "event_id", "ts", "price")
    return market.latest_k(rows, "ticker", 2000, "ts", "event_id").select("ticker", "event_id", "price")


def ticker_class(spark: SparkSession, d: str) -> DataFrame:
    held = src.trades(spark, d).select("ticker").distinct()
    known = spark.createDataFrame([(t,) for t in (*src.KEYWORDS, "INFY.BO")], "ticker string")
    return held.unionByName(known).select("ticker", scalars.ticker_class(F.col("ticker")).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        live_price,
        live_price_fresh,
        latest_price,
        ohlcv_insert_if_absent,
        daily_insert_sink,
        tracked_tickers,
        tracked_tickers_default,
        asof_price,
        market_hours_ticks,
        market_hours_minute,
        latest_k_bars,
        chart_buffer,
        ticker_class,
    )
}
QUERIES |= {"ohlcv_bars_1d": _bars("1 day"), "ohlcv_bars_1h": _bars("1 hour"), "ohlcv_bars_15m": _bars("15 minutes")}


def _bar_sql(interval: str) -> str:
    return (
        f"SELECT ticker, time_bucket(INTERVAL '{interval}', ts) AS bar_ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, "
        f"min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM v_ticks GROUP BY 1, 2"
    )


_LOCAL = "(ts + INTERVAL 330 MINUTES)"
SQL = {
    "live_price": "SELECT ticker, price FROM v_live",
    "live_price_fresh": (
        "SELECT ticker, arg_max(price, (ts, event_id)) AS price FROM v_ticks WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > "
        "TIMESTAMP '2024-01-15 11:00:00' GROUP BY ticker"
    ),
    "latest_price": (
        f"WITH b AS ({_bar_sql('1 hour')}), c AS (SELECT ticker, arg_max(close, bar_ts) AS close FROM b GROUP BY ticker) SELECT l.ticker, "
        f"CASE WHEN CAST(substr(l.ticker, 2) AS INT) % 2 = 0 AND l.ticker <> 'T4' AND l.price > 0 THEN l.price ELSE c.close END AS price "
        f"FROM v_live l LEFT JOIN c ON c.ticker = l.ticker"
    ),
    "ohlcv_bars_1d": _bar_sql("1 day"),
    "ohlcv_bars_1h": _bar_sql("1 hour"),
    "ohlcv_bars_15m": _bar_sql("15 minutes"),
    "daily_insert_sink": (
        f"SELECT ticker, bar_ts, open, close + CASE WHEN day(bar_ts) <= 12 THEN 0 WHEN day(bar_ts) <= 20 THEN 1 ELSE 3 END AS close FROM ({_bar_sql('1 day')})"
    ),
    "ohlcv_insert_if_absent": (
        f"SELECT ticker, bar_ts, CASE WHEN bar_ts < TIMESTAMP '2024-01-16' THEN 1.0::DOUBLE ELSE open END AS open, high, low, close, "
        f"volume FROM ({_bar_sql('1 day')})"
    ),
    "tracked_tickers": "SELECT DISTINCT ticker FROM v_open UNION SELECT unnest(['^NSEI', '^BSESN'])",
    "tracked_tickers_default": "SELECT unnest(['RELIANCE.NS', 'TCS.NS', 'INFY.NS', '^NSEI', '^BSESN']) AS ticker",
    "asof_price": (
        "SELECT t.id, t.ticker, t.ts, p.price AS asof_price FROM (SELECT id, ticker, ts - INTERVAL 1 HOUR AS ts FROM v_trades) t ASOF LEFT "
        "JOIN (SELECT ticker, ts, arg_max(price, event_id) AS price FROM v_ticks GROUP BY ALL) p ON p.ticker = t.ticker AND t.ts >= p.ts"
    ),
    "market_hours_ticks": (
        f"SELECT event_id, ticker, ts, price FROM v_ticks WHERE isodow{_LOCAL} <= 5 AND hour{_LOCAL} * 3600 + minute{_LOCAL} * 60 + "
        f"second{_LOCAL} BETWEEN 33300 AND 55800"
    ),
    "market_hours_minute": f"SELECT event_id, isodow{_LOCAL} <= 5 AND hour{_LOCAL} * 100 + minute{_LOCAL} BETWEEN 915 AND 1530 AS open FROM v_ticks",
    "latest_k_bars": (
        f"SELECT ticker, bar_ts, close, CAST(row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS INT) AS n FROM "
        f"({_bar_sql('1 hour')}) QUALIFY n <= 21"
    ),
    "chart_buffer": (
        "SELECT ticker, event_id, price FROM v_ticks QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) <= "
        "2000"
    ),
    "ticker_class": (
        "SELECT ticker, CASE WHEN starts_with(ticker, '^') THEN 'INDEX' WHEN ends_with(ticker, '.NS') THEN 'NSE' WHEN ends_with(ticker, "
        "'.BO') THEN 'BSE' ELSE 'OTHER' END AS kind FROM (SELECT DISTINCT ticker FROM v_trades UNION ALL SELECT unnest(['ITC.NS', 'LT.NS', "
        "'ERING.NS', 'ONING.NS', 'THING.NS', '^NSEI', 'INFY.BO']))"
    ),
}
