"""The advisor's endpoints as functions of its tables: each returns a DataFrame; none collects.

An Advisor holds DataFrames of the schemas in sources/schemas.py (with timestamps without zone, in UTC) and the ticks.
A user of None, as for a request without a session, gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import history, market, positions, trading


@dataclass
class Advisor:
    users: DataFrame
    trades: DataFrame  # id, user_id, ticker, side, quantity, fill_price, ts
    limits: DataFrame  # user_id, ticker, sl_pct, tg_pct
    ticks: DataFrame  # event_id, ts, ticker, price
    alerts: DataFrame  # id, user_id, ticker, alert_type, message, signal, price_at_alert, is_read, created_at
    feedback: DataFrame  # alert_id, user_id, is_positive
    start_balance: float = 100000.0

    def _own(self, rows: DataFrame, user: int | None) -> DataFrame:
        return rows.where(F.col("user_id") == F.lit(user).cast("long"))

    def holdings(self, user: int | None) -> DataFrame:
        """Open positions with live values and limits."""
        own = positions.average_cost(self._own(self.trades, user))
        return positions.valued(own, market.live_price(self.ticks)).join(self._own(self.limits, user), ["user_id", "ticker"], "left")

    def order(self, orders: DataFrame) -> DataFrame:
        """Outcomes of orders (id, user_id, ticker, side, quantity, price, ts) against the users' balances."""
        return trading.execute_trades(orders, self.users.select(F.col("id").alias("user_id"), F.col("virtual_balance").alias("balance")), self.ticks)

    def balance_events(self, executed: DataFrame) -> DataFrame:
        """The message that each filled order sends to its user."""
        done = executed.where(F.col("status") == trading.OK)
        return done.select(
            "user_id",
            F.to_json(
                F.struct(F.lit("balance_update").alias("type"), "user_id", F.col("virtual_balance_after").alias("balance")),
            ).alias("payload"),
        )

    def set_limits(self, asked: DataFrame) -> DataFrame:
        """The limits after requests (user_id, ticker, sl_pct, tg_pct); a null in a request keeps what is set."""
        new = asked.select("user_id", "ticker", F.col("sl_pct").alias("sl_new"), F.col("tg_pct").alias("tg_new"))
        return self.limits.join(new, ["user_id", "ticker"], "left").select(
            "user_id",
            "ticker",
            F.coalesce("sl_new", "sl_pct").alias("sl_pct"),
            F.coalesce("tg_new", "tg_pct").alias("tg_pct"),
        )

    def recent_trades(self, user: int | None) -> DataFrame:
        return self._own(self.trades, user).orderBy(F.desc("ts"), F.desc("id")).limit(50)

    def history(self, user: int | None, now: str, interval: str = "1 hour") -> DataFrame:
        """user_id, time, label, n_open, total_value."""
        prices = market.bars(self.ticks, interval).select("ticker", F.col("bar_ts").alias("ts"), "close")
        rows = history.history(self._own(self.trades, user), prices, self.start_balance, now)
        return rows.select(
            "user_id",
            F.col("ts").alias("time"),
            F.date_format(scalars.local_time(F.col("ts")), "MMM dd HH:mm").alias("label"),
            "n_open",
            "total_value",
        )

    def inbox(self, user: int | None) -> DataFrame:
        return self._own(self.alerts, user).orderBy(F.desc("created_at"), F.desc("id")).limit(30)

    def unread(self, user: int | None) -> DataFrame:
        return self._own(self.alerts, user).where(~F.col("is_read")).agg(F.count("*").alias("n")).select("n", scalars.badge(F.col("n")).alias("badge"))

    def mark_read(self, user: int | None, alert: int) -> DataFrame:
        """The alerts after one of the user's is marked."""
        mine = F.coalesce((F.col("user_id") == F.lit(user).cast("long")) & (F.col("id") == alert), F.lit(False))
        return self.alerts.withColumn("is_read", mine | F.col("is_read"))

    def owned_feedback(self) -> DataFrame:
        """Feedback on alerts of the sender."""
        own = self.alerts.select(F.col("id").alias("alert_id"), "user_id")
        return self.feedback.join(own, ["alert_id", "user_id"], "left_semi")


def wide_history(roi: DataFrame, tickers: list[str]) -> DataFrame:
    """Rows (time, ticker, roi) as one column for each ticker; for display."""
    return roi.groupBy("time").pivot("ticker", tickers).agg(F.first("roi"))
