"""What alerts and signals were worth: engagement and false alerts, the return of following all signals, the risk of a portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import half_up
from ledgerloom.operators.market import as_of, instant

#: Hours after an alert in which a trade counts as an answer to it, and days after which a trade's result is looked at.
ANSWER_HOURS, RESULT_DAYS = 24, 7
#: Least daily return of a portfolio, at the 5th percentile, that is within bounds.
VAR_SHARE, VAR_MOST = 0.05, -0.15
PPM = 1_000_000


def answers(alerts: DataFrame, trades: DataFrame, hours: int = ANSWER_HOURS) -> DataFrame:
    """id of alerts with the trade that answers each: trade_id, side, fill_price, ts. A trade answers the latest alert of its user and
    ticker before it, if that is no older than so many hours, and an alert is answered by the first such trade, so matches are one
    to one. alerts: (id, user_id, ticker, created_at); trades: (id, user_id, ticker, side, fill_price, ts)."""
    asked = alerts.select("user_id", "ticker", (F.col("created_at") + F.expr("INTERVAL 1 MICROSECOND")).alias("ts"), "id", "created_at")
    given = trades.select("user_id", "ticker", "ts", F.col("id").alias("trade_id"), "side", "fill_price")
    matched = as_of(given, asked, ["user_id", "ticker"], "ts", ["id", "created_at"], "id", bucket="1 day")
    matched = matched.where(F.col("ts") <= F.col("asof_created_at") + F.expr(f"INTERVAL {hours} HOURS"))
    at = instant("ts", "trade_id")
    return matched.groupBy(F.col("asof_id").alias("id")).agg(
        *[F.min_by(c, at).alias(c) for c in ("trade_id", "side", "fill_price", "ts")],
        F.first("ticker").alias("ticker"),
    )


def lost(answered: DataFrame, ticks: DataFrame, days: int = RESULT_DAYS) -> DataFrame:
    """answered with loss: whether the price so many days later is below a buy's or above a sale's; null while the data end earlier.
    ticks: (ticker, ts, event_id, price)."""
    later = answered.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days} DAYS"))
    end = ticks.agg(F.max("ts").alias("end"))
    found = as_of(later, ticks.select("ticker", "ts", "event_id", "price"), ["ticker"], "ts", ["price"], "event_id", bucket="1 day")
    after = F.when(F.col("ts") <= F.col("end"), F.col("asof_price"))
    loss = F.when(F.col("side") == "BUY", after < F.col("fill_price")).otherwise(after > F.col("fill_price"))
    return found.join(F.broadcast(end)).select("id", loss.alias("loss"))


def engagement(alerts: DataFrame, results: DataFrame, ratings: DataFrame) -> DataFrame:
    """By alert_type: n alerts, how many were answered (also in percent), how many answers have a known result and led to a loss (also in
    percent: false alerts), how many ratings there are and how many are positive. results: (id, loss); ratings: (alert_type, is_positive)."""
    rows = alerts.select("id", "alert_type").join(results.withColumn("answered", F.lit(1)), "id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rows.groupBy("alert_type").agg(
        F.count("*").alias("n"),
        count(F.col("answered")).alias("answered"),
        F.count("loss").alias("known"),
        count(F.col("loss").cast("int")).alias("losses"),
    )
    rated = ratings.groupBy("alert_type").agg(F.count("*").alias("rated"), count(F.col("is_positive").cast("int")).alias("positive"))
    share = lambda a, b: half_up(F.col(a) / F.when(F.col(b) > 0, F.col(b)) * 100)
    return sums.join(rated, "alert_type", "left").select(
        "alert_type",
        "n",
        "answered",
        share("answered", "n").alias("engagement_pct"),
        "known",
        "losses",
        share("losses", "known").alias("false_pct"),
        F.coalesce("rated", F.lit(0)).alias("rated"),
        F.coalesce("positive", F.lit(0)).alias("positive"),
    )


def followed(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """bar_ts, n_held, r: the day's return, in millionths, of following all signals: each ticker whose last BUY or SELL before the day
    was a BUY is held, in equal parts; nothing held returns 0. signals: (id, ticker, signal, created_at); returns: (ticker, bar_ts, ret)."""
    turns = signals.where("signal <> 'HOLD'").select("ticker", (F.col("created_at") + F.expr("INTERVAL 1 MICROSECOND")).alias("ts"), "id", "signal")
    days = returns.select("ticker", F.col("bar_ts").alias("ts"), F.floor(F.col("ret") * PPM + 0.5).alias("r"))
    held = as_of(days, turns, ["ticker"], "ts", ["signal"], "id", bucket="1 day")
    long = F.col("asof_signal") == "BUY"
    daily = held.groupBy(F.col("ts").alias("bar_ts")).agg(
        F.coalesce(F.sum(F.when(long, 1)), F.lit(0)).alias("n_held"),
        F.coalesce(F.sum(F.when(long, F.col("r"))), F.lit(0)).alias("sum"),
    )
    mean = F.when(F.col("n_held") > 0, F.floor(F.col("sum") / F.when(F.col("n_held") > 0, F.col("n_held")) + 0.5)).otherwise(0)
    return daily.select("bar_ts", "n_held", mean.cast("long").alias("r"))


def equity_curve(daily: DataFrame, days: int = 10) -> DataFrame:
    """daily (bar_ts, n_held, r) with equity, what one unit has become, its logarithm (null once nothing is left), and sharpe over the last
    so many days, null with fewer. One row a day, in one task."""
    by = Window.partitionBy(F.lit(0)).orderBy("bar_ts")
    last, all_of = by.rowsBetween(1 - days, 0), by.rowsBetween(Window.unboundedPreceding, 0)
    n, s, q = F.count("*").over(last), F.sum("r").over(last), F.sum(F.col("r") * F.col("r")).over(last)
    spread = q * days - s * s
    sharpe = (s / float(days)) / F.sqrt(F.when(spread > 0, spread) / float(days * (days - 1)))
    growth = F.when(F.col("r") > -PPM, F.log(1 + F.col("r") / float(PPM)))
    log_equity = F.when(F.min("r").over(all_of) > -PPM, F.sum(growth).over(all_of))
    return daily.select(
        "bar_ts",
        "n_held",
        "r",
        half_up(F.coalesce(F.exp(log_equity), F.lit(0.0)), 6).alias("equity"),
        half_up(log_equity, 6).alias("log_equity"),
        F.when(n == days, half_up(sharpe, 6)).alias("sharpe"),
    )


def portfolio_var(valued: DataFrame, returns: DataFrame) -> DataFrame:
    """user_id, n_days, var_5 (return of the whole portfolio at the 5th percentile, nearest rank, by historical simulation: each day's
    returns on what is held now) and within, whether it is no worse than the bound. valued: (user_id, ticker, current_value);
    returns: (ticker, bar_ts, ret). A ticker without a return on a day stands still. Sums are in millionths of cents."""
    cents = F.floor(F.col("current_value") * 100 + 0.5)
    total = valued.groupBy("user_id").agg(F.sum(cents).alias("total"))
    moves = valued.join(returns, "ticker").groupBy("user_id", "bar_ts").agg(F.sum(cents * F.floor(F.col("ret") * PPM + 0.5)).alias("move"))
    rank = lambda n: F.ceil(n * VAR_SHARE)
    ranked = moves.groupBy("user_id").agg(F.count("*").alias("n_days"), F.sort_array(F.collect_list("move")).alias("m"))  # one number a day
    worst = F.element_at("m", rank(F.col("n_days")).cast("int"))
    var: Column = worst / F.when(F.col("total") > 0, F.col("total")) / float(PPM)
    rows = ranked.join(total, "user_id").select("user_id", "n_days", half_up(var, 6).alias("var_5"))
    return rows.withColumn("within", F.col("var_5") >= VAR_MOST)
