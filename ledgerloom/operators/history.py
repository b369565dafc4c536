"""Portfolio history: states after trades, prices and a time grid, joined as of each grid instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.market import as_of
from ledgerloom.operators.positions import position_states


def first_trades(trades: DataFrame) -> DataFrame:
    return trades.groupBy("user_id").agg(F.min("ts").alias("start"))


def reach(trades: DataFrame, prices: DataFrame, now: str) -> DataFrame:
    """user_id, start, last, alone: a user's first trade and last instant of the grid; alone without an instant from start on, where the
    last one is `now`."""
    ends = prices.groupBy("ticker").agg(F.max("ts").alias("end"))
    pairs = trades.groupBy("user_id", "ticker").agg(F.min("ts").alias("start")).join(ends, "ticker", "left")
    users = pairs.groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    some = F.coalesce(F.col("end") >= F.col("start"), F.lit(False))
    return users.select("user_id", "start", F.when(some, F.col("end")).otherwise(F.lit(now).cast("timestamp_ntz")).alias("last"), (~some).alias("alone"))


def grid(trades: DataFrame, prices: DataFrame, now: str) -> DataFrame:
    """user_id, ts: the price instants, from a user's first trade on, of tickers that the user ever traded; the single
    instant `now` for users without any. prices: (ticker, ts, close)."""
    # a ticker's instants of a day are one array, and tickers with the same ones count once, by the name of the first
    days = prices.groupBy("ticker", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("ts")).alias("instants"))
    kinds = days.groupBy("day", "instants").agg(F.min("ticker").alias("kind"), F.collect_list("ticker").alias("tickers"))
    pairs = trades.select("user_id", "ticker").distinct().join(first_trades(trades), "user_id")
    found = pairs.join(kinds.select("day", "kind", F.explode("tickers").alias("ticker")), "ticker").where(F.col("day") >= F.to_date("start"))
    found = found.select("user_id", "start", "day", "kind").distinct().join(kinds.drop("tickers"), ["day", "kind"])
    found = found.groupBy("user_id", "start", "day").agg(F.array_distinct(F.flatten(F.collect_list("instants"))).alias("instants"))
    found = found.select("user_id", "start", F.explode("instants").alias("ts")).where("ts >= start").select("user_id", "ts")
    alone = reach(trades, prices, now).where("alone").select("user_id", F.col("last").alias("ts"))
    return found.unionByName(alone)


def running_cash(trades: DataFrame, start: float) -> DataFrame:
    """id, user_id, ts, cash_c: balance in cents after each trade, all of them filled at their price."""
    amount = F.round(F.col("quantity") * F.col("fill_price") * 100).cast("bigint")
    by = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.sum(F.when(F.col("side") == "BUY", -amount).otherwise(amount)).over(by)
    return trades.select("id", "user_id", "ts", (F.lit(round(start * 100)) + moved).alias("cash_c"))


#: Prices by ticker and instant that are broadcast at most; more of them are joined.
PRICES_MOST = 1 << 18


def open_days(trades: DataFrame, last: DataFrame) -> DataFrame:
    """user_id, ticker, since, until, qty, avg, day: the spans of time in which positions are open, up to their user's last instant
    (user_id, last), cut by days; nothing is made for what isn't held."""
    by = Window.partitionBy("user_id", "ticker").orderBy("ts", "id")
    spans = position_states(trades).withColumn("until", F.lead("ts").over(by)).where("qty > 0 AND (until IS NULL OR until > ts)")
    spans = spans.join(last.select("user_id", "last"), "user_id").where("ts <= last")
    to = F.to_date(F.least(F.coalesce("until", "last"), "last"))
    return spans.select("user_id", "ticker", F.col("ts").alias("since"), "until", "qty", "avg", F.explode(F.sequence(F.to_date("ts"), to)).alias("day"))


def filled_prices(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """ticker, ts, asof_close: the last close at or before each wanted instant (ticker, ts) of a ticker."""
    return as_of(wanted, prices.select("ticker", "ts", "close", F.lit(0).alias("o")), ["ticker"], "ts", ["close"], "o", bucket="1 day")


def history(trades: DataFrame, prices: DataFrame, start: float, now: str, prices_most: int = PRICES_MOST) -> DataFrame:
    """user_id, ts, n_open, value: cash and open positions at the last price at or before each grid instant (average
    cost before the first price); only instants after the user last held nothing.

    Positions at instants are many more rows than instants and spans: they are made, priced and added up where a user's instants and
    spans of a day have met, so only instants and spans are shuffled. For that, prices at all instants are broadcast; where they are more
    than prices_most, those at instants with a holder are joined."""
    cash = as_of(grid(trades, prices, now), running_cash(trades, start), ["user_id"], "ts", ["cash_c"], "id").withColumn("day", F.to_date("ts"))
    spans = open_days(trades, reach(trades, prices, now))
    inside = (cash["ts"] >= spans["since"]) & (spans["until"].isNull() | (cash["ts"] < spans["until"]))
    same_day = (cash["user_id"] == spans["user_id"]) & (cash["day"] == spans["day"])
    held = cash.join(spans, same_day & inside, "left").select(cash["user_id"], cash["day"], cash["ts"], "asof_cash_c", "ticker", "qty", "avg")
    n = prices.agg(F.count_distinct("ticker").alias("tickers"), F.count_distinct("ts").alias("instants")).first()
    if n.tickers * (n.instants + 1) <= prices_most:
        instants = prices.select("ts").unionByName(prices.sparkSession.range(1).select(F.lit(now).cast("timestamp_ntz").alias("ts"))).distinct()
        filled = F.broadcast(filled_prices(prices.select("ticker").distinct().crossJoin(instants), prices))
    else:
        filled = filled_prices(held.where("ticker IS NOT NULL").select("ticker", "ts").distinct(), prices)
    priced = held.join(filled, ["ticker", "ts"], "left")
    cents = F.floor(F.col("qty") * F.coalesce("asof_close", "avg") * 100 + 0.5)
    total = priced.groupBy("user_id", "day", "ts", "asof_cash_c").agg(F.count("qty").alias("n_open"), F.sum(cents).alias("stock_c"))
    total = total.select("user_id", "ts", "n_open", (F.col("asof_cash_c") + F.coalesce("stock_c", F.lit(0))).alias("value_c"))
    flat = F.max(F.when(F.col("n_open") == 0, F.col("ts"))).over(Window.partitionBy("user_id"))
    return total.withColumn("flat", flat).where("flat IS NULL OR ts > flat").select("user_id", "ts", "n_open", (F.col("value_c") / 100.0).alias("total_value"))
