"""Streaming queries, run over all input there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import monitor as monitor_plans
from ledgerloom.plans import portfolio
from ledgerloom.sources import tables as src
from ledgerloom.streaming import monitoring, streams


def stream_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_append(streams.bars(streams.tick_stream(spark, d), "1 day"))


def stream_live_price(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_complete(streams.live_prices(streams.tick_stream(spark, d)))


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_append(streams.unique_texts(streams.feed(spark, d, "documents")))


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_append(streams.alert_payloads(streams.tick_stream(spark, d)))


def stream_execute_trades(spark: SparkSession, d: str) -> DataFrame:
    ticks = streams.tick_stream(spark, d).where(F.col("event_type").isin("purchase", "signup", "error"))
    side = F.when(F.col("event_type") == "error", "SELL").otherwise("BUY")
    orders = ticks.select(
        F.col("event_id").alias("id"),
        "user_id",
        "ticker",
        side.alias("side"),
        (F.lit(1) + F.col("event_id") % 10).cast("double").alias("quantity"),
        "price",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )
    table = src.ticks(spark, d).select("ticker", "ts", "event_id", "price")
    return streams.run_orders(orders, table, src.TRADING_BALANCE)


def stream_price_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Tickers with their last price and whether it still lives at the end of the data: an hour after its last tick it
    doesn't (a watermark of an hour, and a minute to live)."""
    rows = streams.run_append(streams.expiring_prices(streams.tick_stream(spark, d)))
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("price", "live"), F.struct("ts", ~F.col("live"))).alias("s"))
    return last.select("ticker", "s.price", "s.live")


def walk_ticks(spark: SparkSession, d: str) -> DataFrame:
    """The ticks as a stream of bars of each ticker's walk: changes and volumes in cents."""
    cents = src.cents(F.col("price"))
    change = F.when(F.col("event_type").isin("click", "purchase"), cents).otherwise(-cents)
    return streams.tick_stream(spark, d).select("ticker", "ts", "event_id", "price", change.alias("change"), cents.alias("volume"))


def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    """alert_messages from the stream of ticks: all there is comes in one batch, after which the monitor looks once."""
    held, limits, change = monitor_plans.held_at_monitor(spark, d)
    found = monitoring.run_monitor(walk_ticks(spark, d), held, limits, change, base=monitor_plans.WALK_BASE, bars_before=monitor_plans.BARS_BEFORE)
    return found.select("user_id", "ticker", "alert_type", "signal", "message", "price")


COOLDOWN_HOURS = 72


def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of a user, ticker and kind, three days apart at least."""
    kind = src.pick(src.ALERT_TYPES, F.col("event_id") % 6)
    found = streams.tick_stream(spark, d).where("event_type = 'error'")
    found = found.select("user_id", "ticker", kind.alias("alert_type"), "ts", F.col("event_id").alias("id"))
    return streams.run_append(monitoring.cooled(found, COOLDOWN_HOURS * 3600)).select("user_id", "ticker", "alert_type", "id")


QUERIES = {f.__name__: f for f in (stream_ohlcv, stream_live_price, stream_dedupe, stream_alerts, stream_execute_trades, stream_price_expiry, stream_monitor, stream_cooldown)}

SQL = {
    "stream_ohlcv": (
        "SELECT ticker, time_bucket(INTERVAL '1 day', ts) AS bar_ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, "
        "min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM v_ticks GROUP BY 1, 2 HAVING "
        "time_bucket(INTERVAL '1 day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM v_ticks) - INTERVAL 1 HOUR"
    ),
    "stream_live_price": "SELECT ticker, price FROM v_live",
    "stream_dedupe": "SELECT DISTINCT md5(text) AS digest FROM documents",
    "stream_alerts": """SELECT user_id, '{"user_id":' || user_id || ',"alert_type":"' || alert_type || '","ticker":"' || ticker || '","message":"' || message || '","signal":"' || signal || '"}' AS payload FROM v_alerts WHERE user_id > 0""",
    "stream_execute_trades": portfolio.REPLAYED,
    "stream_monitor": monitor_plans.SQL["alert_messages"],
    "stream_cooldown": (
        "WITH RECURSIVE s AS (SELECT user_id, ticker, alert_type, created_at AS seen, id, row_number() OVER (PARTITION BY user_id, ticker, alert_type "
        "ORDER BY created_at, id) AS n FROM v_alerts), r AS (SELECT user_id, ticker, alert_type, n, seen, id, seen AS passed, true AS let FROM s WHERE n = 1 "
        "UNION ALL SELECT s.user_id, s.ticker, s.alert_type, s.n, s.seen, s.id, CASE WHEN s.seen >= r.passed + INTERVAL 72 HOURS THEN s.seen ELSE r.passed "
        "END, s.seen >= r.passed + INTERVAL 72 HOURS FROM r JOIN s ON s.user_id = r.user_id AND s.ticker = r.ticker AND s.alert_type = r.alert_type AND "
        "s.n = r.n + 1) SELECT user_id, ticker, alert_type, id FROM r WHERE let"
    ),
    "stream_price_expiry": (
        "SELECT ticker, arg_max(price, (ts, event_id)) AS price, max(ts) + INTERVAL 60 SECONDS >= (SELECT max(ts) FROM v_ticks) - INTERVAL "
        "1 HOUR AS live FROM v_ticks GROUP BY ticker"
    ),
}
