"""Validated trade execution: an ordered state machine of each user over all its tickers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import SELL_TAX, SLIPPAGE, STOCK_CAP, ZONE
from ledgerloom.operators.market import as_of

OK = "OK"
RESULT = "id bigint, user_id bigint, ticker string, side string, quantity double, fill_price double, slippage double, ts timestamp_ntz, virtual_balance_after double, status string"


@dataclass(frozen=True)
class Gates:
    """Further checks of an order, each off while it is None: what a ticker looks like (regular expression), minutes of the local day
    between which the market is open on weekdays, and, of a buy, the largest share of the account that one order may take and that a
    sector may reach. sectors: ticker to sector; one that isn't listed is a sector of its own."""

    tickers: str | None = None
    hours: tuple[int, int] | None = None
    order_share: float | None = None
    sector_share: float | None = None
    sectors: dict[str, str] = field(default_factory=dict)
    zone: str = ZONE

    def closed(self, ts: datetime | None) -> bool:
        """ts: without zone, in UTC."""
        if self.hours is None or ts is None or pd.isna(ts):
            return False
        at = pd.Timestamp(ts).tz_localize("UTC").tz_convert(self.zone)
        return at.dayofweek > 4 or not self.hours[0] * 60 <= at.hour * 3600 + at.minute * 60 + at.second <= self.hours[1] * 60

    def sector(self, ticker: str) -> str:
        return self.sectors.get(ticker, ticker)


#: The design's limits: a fifth of the account for one order, two fifths for a sector, and the market's hours.
DESIGN = Gates(order_share=0.20, sector_share=0.40, hours=(9 * 60 + 15, 15 * 60 + 30))


class Account:
    """A user's balance and holdings: ticker to [quantity, average cost]."""

    def __init__(self, balance: float, held: dict[str, list[float]] | None = None, gates: Gates | None = None) -> None:
        self.balance, self.held, self.gates = balance, held or {}, gates or Gates()

    def execute(
        self,
        ticker: str,
        side: str,
        quantity: float,
        price: float | None,
        quotes: dict[str, float],
        ts: datetime | None = None,
    ) -> tuple[str, float | None]:
        """(status, execution price); the first rule that fails names the status and nothing changes. price: the ticker's live
        price; quotes: live prices of the other tickers that may be held."""
        gates = self.gates
        if gates.tickers is not None and (ticker is None or not re.fullmatch(gates.tickers, ticker)):
            return "BAD_TICKER", None
        if gates.closed(ts):
            return "CLOSED", None
        if side not in ("BUY", "SELL"):
            return "BAD_SIDE", None
        if not quantity > 0:
            return "BAD_QUANTITY", None
        if price is None or not price > 0:
            return "NO_PRICE", None
        own = self.held.get(ticker)
        if side == "BUY":
            fill = price * (1 + SLIPPAGE)
            cost = fill * quantity
            if self.balance < cost:
                return "BALANCE", None
            live = [(q, price if t == ticker else quotes.get(t)) for t, (q, _) in self.held.items() if q > 0]
            if any(p is None for _, p in live):
                return "NO_PRICE", None
            total = sum(q * p for q, p in live) + self.balance
            if gates.order_share is not None and cost / total > gates.order_share:
                return "ORDER_CAP", None
            if ((own[0] * price if own else 0.0) + cost) / total > STOCK_CAP:
                return "STOCK_CAP", None
            if gates.sector_share is not None:
                prices = quotes | {ticker: price}
                alike = sum(q * prices[t] for t, (q, _) in self.held.items() if q > 0 and gates.sector(t) == gates.sector(ticker))
                if (alike + cost) / total > gates.sector_share:
                    return "SECTOR_CAP", None
            self.balance -= cost
            if own:
                own[1] = (own[0] * own[1] + quantity * fill) / (own[0] + quantity)
                own[0] += quantity
            else:
                self.held[ticker] = [quantity, fill]
            return OK, fill
        if own is None or own[0] < quantity:
            return "OVERSELL", None
        fill = price * (1 - SLIPPAGE)
        self.balance += fill * quantity * (1 - SELL_TAX)
        own[0] -= quantity
        if own[0] == 0:
            del self.held[ticker]
        return OK, fill


def live_quotes(orders: DataFrame, accounts: DataFrame, ticks: DataFrame) -> DataFrame:
    """user_id, id, quotes: for each buy, the latest prices at its time of the other tickers that its user holds or has bought
    before (array of ticker and price; as long as the user has tickers). ticks: (ticker, ts, event_id, price)."""
    buys = orders.where("side = 'BUY'").select("user_id", "id", "ts", "ticker")
    owned = buys.groupBy("user_id", F.col("ticker").alias("other")).agg(F.min(F.struct("ts", "id")).alias("since"))
    held = accounts.where("held IS NOT NULL").select("user_id", F.explode(F.map_keys(F.from_json("held", "map<string, array<double>>"))).alias("other"))
    owned = owned.unionByName(held.withColumn("since", F.lit(None).cast(owned.schema["since"].dataType)))
    owned = owned.groupBy("user_id", "other").agg(F.min("since").alias("since"), F.bool_or(F.col("since").isNull()).alias("before"))
    wanted = buys.join(owned, "user_id").where((F.col("other") != F.col("ticker")) & (F.col("before") | (F.col("since") < F.struct("ts", "id"))))
    wanted = wanted.select("user_id", "id", F.col("other").alias("ticker"), "ts")
    quoted = as_of(wanted, ticks.where("price > 0"), ["ticker"], "ts", ["price"], "event_id", bucket="1 day").where("asof_price IS NOT NULL")
    return quoted.groupBy("user_id", "id").agg(F.collect_list(F.struct("ticker", F.col("asof_price").alias("price"))).alias("quotes"))


def executed(orders: DataFrame, accounts: DataFrame, ticks: DataFrame, gates: Gates | None = None) -> DataFrame:
    """RESULT and state: a row for each order, and one for each user after its orders (status STATE, its holdings as JSON in
    state). orders: (id, user_id, ticker, side, quantity, price, ts); accounts: (user_id, balance, held as JSON or null).
    Users stream through sorted partitions, and a user's state is its holdings, so no user's orders are collected."""
    names = [*(c.split()[0] for c in RESULT.split(", ")), "state"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, account = None, None

        def last() -> list[tuple]:
            known = account is not None and not pd.isna(account.balance)
            return [(None, user, None, None, None, None, None, None, account.balance, "STATE", json.dumps(account.held))] if known else []

        for t in batches:
            rows = []
            for r in t.itertuples(index=False):
                if r.user_id != user or account is None:
                    rows += last()
                    user, account = r.user_id, Account(r.balance, json.loads(r.held) if r.held else None, gates)
                if pd.isna(r.balance):
                    status, fill = "NO_USER", None
                else:
                    quotes = {q["ticker"]: q["price"] for q in r.quotes} if r.quotes is not None else {}
                    status, fill = account.execute(r.ticker, r.side, r.quantity, None if pd.isna(r.price) else r.price, quotes, r.ts)
                balance = None if status == "NO_USER" else account.balance
                rows.append((r.id, r.user_id, r.ticker, r.side, r.quantity, fill, SLIPPAGE if status == OK else None, r.ts, balance, status, None))
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(last(), columns=names)

    rows = orders.select("id", "user_id", "ticker", "side", "quantity", "price", "ts").join(accounts.select("user_id", "balance", "held"), "user_id", "left")
    rows = rows.join(live_quotes(orders, accounts, ticks), ["user_id", "id"], "left")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "id").mapInPandas(run, RESULT + ", state string")


def execute_trades(orders: DataFrame, balances: DataFrame, ticks: DataFrame | None = None, gates: Gates | None = None) -> DataFrame:
    """Every order with its outcome, in order of time and id for each user; a buy's share of the account is measured at live
    prices of all holdings. orders: (id, user_id, ticker, side, quantity, price, ts), price the ticker's live price;
    balances: (user_id, balance); orders of unknown users get NO_USER. ticks: (ticker, ts, event_id, price); if there are none,
    the prices of all users' orders. gates: further checks."""
    if ticks is None:
        ticks = orders.select("ticker", "ts", F.col("id").alias("event_id"), "price")
    accounts = balances.select("user_id", F.col("balance").cast("double").alias("balance"), F.lit(None).cast("string").alias("held"))
    return executed(orders, accounts, ticks, gates).where("status <> 'STATE'").drop("state")


def validated(orders: DataFrame, balance: float) -> DataFrame:
    """The rules that need no holdings, as columns: side, quantity, price and a balance before any trade."""
    cost = F.col("quantity") * F.col("price") * (1 + SLIPPAGE)
    status = (
        F.when(~F.col("side").isin("BUY", "SELL"), "BAD_SIDE")
        .when(~(F.col("quantity") > 0), "BAD_QUANTITY")
        .when(F.col("price").isNull() | ~(F.col("price") > 0), "NO_PRICE")
        .when((F.col("side") == "BUY") & (F.lit(balance) < cost), "BALANCE")
        .when((F.col("side") == "BUY") & (cost / F.lit(balance) > STOCK_CAP), "STOCK_CAP")
        .otherwise(OK)
    )
    return orders.withColumn("status", status)


def concentration(valued: DataFrame) -> DataFrame:
    """user_id, ticker, share of the user's stock value, over_cap. valued: (user_id, ticker, current_value)."""
    cents = F.floor(F.col("current_value") * 100 + 0.5)
    total = F.sum(cents).over(Window.partitionBy("user_id"))
    share = cents / F.when(total > 0, total)
    return valued.select("user_id", "ticker", share.alias("share"), (share > STOCK_CAP).alias("over_cap"))
