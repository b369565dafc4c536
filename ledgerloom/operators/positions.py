"""Positions by average cost, and their valuation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ratio_percent
from ledgerloom.operators.market import instant


#: Trades from which a pair is cut into slices of time.
HOT_TRADES = 1_000_000
SLICE = "1 day"


def average_cost(trades: DataFrame) -> DataFrame:
    """user_id, ticker, quantity, avg_cost after all trades: a buy averages, a sale keeps the average, none left resets.
    It is the last of each pair's states, so a pair's trades never meet in one array."""
    return last_states(position_states(trades))


def last_states(states: DataFrame) -> DataFrame:
    """user_id, ticker, quantity, avg_cost of each pair's last state."""
    at = instant("ts", "id")
    return states.groupBy("user_id", "ticker").agg(F.max_by("qty", at).alias("quantity"), F.max_by("avg", at).alias("avg_cost"))


def split_states(trades: DataFrame, hot_trades: int = HOT_TRADES) -> DataFrame:
    """position_states where a pair may hold a large share of all trades: pairs of so many trades are cut into slices, the others
    stream whole. The list of hot pairs is no longer than trades over hot_trades."""
    hot = trades.groupBy("user_id", "ticker").agg(F.count("*").alias("n")).where(F.col("n") >= hot_trades).select("user_id", "ticker")
    whole, cut = (trades.join(hot, ["user_id", "ticker"], how) for how in ("left_anti", "left_semi"))
    return position_states(whole).unionByName(sliced_states(cut))


def sliced_states(trades: DataFrame, span: str = SLICE) -> DataFrame:
    """position_states by a scan that composes, so slices of a pair are worked on apart; equal to it but for rounding of doubles
    (exact for whole quantities; averages to a relative 1e-12 or so).

    A trade maps a quantity q to max(q + d, 0). Over a slice these compose to max(q + a, a - m), with a the sum of the slice and m the
    least of its running sums, so sums and minima over slices give the quantity with which each begins. Given the quantities, a trade maps
    an average x to u x + v: a buy weighs it, a sale keeps it, none left sets it to 0. These compose too; each slice gives one (u, v), a
    pass over a pair's slices gives the average with which each begins, and a second one over its trades the averages."""
    pair = ["user_id", "ticker"]
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = trades.select(*pair, "id", "ts", signed.alias("d"), F.col("fill_price").alias("p"), F.window("ts", span)["start"].alias("slice"))
    within = Window.partitionBy(*pair, "slice").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("w", F.sum("d").over(within)).withColumn("low", F.min("w").over(within))
    slices = rows.groupBy(*pair, "slice").agg(F.sum("d").alias("a"), F.min("w").alias("m"))
    before = Window.partitionBy(*pair).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("t", F.coalesce(F.sum("a").over(before), F.lit(0.0)))
    least = F.coalesce(F.min(F.col("t") + F.col("m")).over(before), F.lit(0.0))
    starts = slices.select(*pair, "slice", (F.col("t") - F.least(F.lit(0.0), least)).alias("q_in"))
    qty = F.col("w") - F.least(-F.col("q_in"), F.col("low"))
    rows = rows.join(starts, [*pair, "slice"]).select(*pair, "slice", "id", "ts", "d", "p", F.when(qty > 0, qty).otherwise(0.0).alias("qty"))
    bought = F.col("d") > 0
    u = F.when(F.col("qty") == 0, 0.0).when(bought, (F.col("qty") - F.col("d")) / F.when(F.col("qty") > 0, F.col("qty"))).otherwise(1.0)
    v = F.when((F.col("qty") > 0) & bought, F.col("d") * F.col("p") / F.when(F.col("qty") > 0, F.col("qty"))).otherwise(0.0)
    rows = rows.select(*pair, "slice", "id", "ts", "qty", u.alias("u"), v.alias("v"))
    key = "user_id bigint, ticker string, slice timestamp_ntz"

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(u, v) of each slice."""
        last, x, y = None, 1.0, 0.0
        for t in batches:
            out = []
            for own, u, v in zip(zip(t.user_id, t.ticker, t.slice, strict=True), t.u, t.v, strict=True):
                if own != last:
                    if last is not None:
                        out.append((*last, x, y))
                    last, x, y = own, 1.0, 0.0
                x, y = u * x, u * y + v
            yield pd.DataFrame(out, columns=["user_id", "ticker", "slice", "u", "v"])
        if last is not None:
            yield pd.DataFrame([(*last, x, y)], columns=["user_id", "ticker", "slice", "u", "v"])

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The average before each slice of a pair."""
        last, x = None, 0.0
        for t in batches:
            out = []
            for own, u, v in zip(zip(t.user_id, t.ticker, strict=True), t.u, t.v, strict=True):
                if own != last:
                    last, x = own, 0.0
                out.append(x)
                x = u * x + v
            yield pd.DataFrame({"user_id": t.user_id, "ticker": t.ticker, "slice": t.slice, "avg_in": out})

    def averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, 0.0
        for t in batches:
            out = []
            for own, first, u, v in zip(zip(t.user_id, t.ticker, t.slice, strict=True), t.avg_in, t.u, t.v, strict=True):
                if own != last:
                    last, x = own, first
                x = u * x + v
                out.append(x)
            yield pd.DataFrame({"user_id": t.user_id, "ticker": t.ticker, "id": t.id, "ts": t.ts, "qty": t.qty, "avg": out})

    each = [*pair, "slice"]
    maps = rows.repartition(*each).sortWithinPartitions(*each, "ts", "id").mapInPandas(composed, key + ", u double, v double")
    carried = maps.repartition(*pair).sortWithinPartitions(*each).mapInPandas(begun, key + ", avg_in double")
    return rows.join(carried, each).repartition(*each).sortWithinPartitions(*each, "ts", "id").mapInPandas(
        averaged,
        "user_id bigint, ticker string, id bigint, ts timestamp_ntz, qty double, avg double",
    )


def position_states(trades: DataFrame) -> DataFrame:
    """user_id, ticker, id, ts, qty, avg after every trade. Pairs stream through sorted partitions with two numbers of
    state, so a pair with very many trades needs no more memory than one with few."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, q, a = None, 0.0, 0.0
        for t in batches:
            held, cost = [], []
            for u, k, d, p in zip(t.user_id, t.ticker, t.d, t.p, strict=True):
                if (u, k) != pair:
                    pair, q, a = (u, k), 0.0, 0.0
                if q + d <= 0:
                    q, a = 0.0, 0.0
                elif d > 0:
                    q, a = q + d, (q * a + d * p) / (q + d)
                else:
                    q += d
                held.append(q)
                cost.append(a)
            yield pd.DataFrame({"user_id": t.user_id, "ticker": t.ticker, "id": t.id, "ts": t.ts, "qty": held, "avg": cost})

    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = trades.select("user_id", "ticker", "id", "ts", signed.alias("d"), F.col("fill_price").alias("p"))
    return rows.repartition("user_id", "ticker").sortWithinPartitions("user_id", "ticker", "ts", "id").mapInPandas(
        fold,
        "user_id bigint, ticker string, id bigint, ts timestamp_ntz, qty double, avg double",
    )


def valued(positions: DataFrame, live: DataFrame) -> DataFrame:
    """Open positions with current value, invested sum, profit and percent; without a live price, at average cost."""
    price = F.coalesce(F.col("price"), F.col("avg_cost"))
    rows = positions.where("quantity > 0").join(live, "ticker", "left").select("user_id", "ticker", "quantity", "avg_cost", price.alias("price"))
    value, invested = F.col("price") * F.col("quantity"), F.col("avg_cost") * F.col("quantity")
    return rows.select(
        "*",
        value.alias("current_value"),
        invested.alias("invested"),
        (value - invested).alias("pnl"),
        ratio_percent(value - invested, invested).alias("pnl_pct"),
    )
