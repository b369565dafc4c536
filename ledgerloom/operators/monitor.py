"""The proactive monitor: features of each ticker once, then alerts of each open position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import half_up
from ledgerloom.operators.market import latest_k, with_rows_before

# Periods and thresholds of the checks.
RSI_PERIOD, OVERBOUGHT, OVERSOLD = 14, 75, 30
VOLUME_DAYS, VOLUME_TIMES = 20, 3
SENTIMENT_DROP = -0.4

#: A ticker's bars of one such span of time are one partition.
BARS_TOGETHER = "1 day"


def rsi_series(bars: DataFrame) -> DataFrame:
    """ticker, ts, event_id, rsi: simple averages of the last 14 gains and losses; none without a loss or with fewer
    than 14 differences. bars: (ticker, ts, event_id, close_c)."""
    bars = with_rows_before(bars.select("ticker", "ts", "event_id", "close_c"), ["ticker"], "ts", "event_id", RSI_PERIOD, BARS_TOGETHER)
    by = Window.partitionBy("ticker", "__bucket").orderBy("ts", "event_id")
    last = by.rowsBetween(-(RSI_PERIOD - 1), 0)
    d = bars.withColumn("d", F.col("close_c") - F.lag("close_c").over(by))
    sums = d.select(
        "ticker",
        "ts",
        "event_id",
        "__carried",
        F.count("d").over(last).alias("n"),
        F.sum(F.greatest("d", F.lit(0))).over(last).alias("gain"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).over(last).alias("loss"),
    ).where("NOT __carried")
    ok = (F.col("n") == RSI_PERIOD) & (F.col("loss") > 0)
    ratio = (F.col("gain") / 14.0) / F.when(F.col("loss") > 0, F.col("loss") / 14.0)
    return sums.select("ticker", "ts", "event_id", F.when(ok, 100 - 100 / (1 + ratio)).alias("rsi"))


def volume_series(bars: DataFrame) -> DataFrame:
    """ticker, ts, event_id, volume_c, spike: whether the volume is over three times the mean of the 20 bars before; null
    with fewer."""
    bars = with_rows_before(bars.select("ticker", "ts", "event_id", "volume_c"), ["ticker"], "ts", "event_id", VOLUME_DAYS, BARS_TOGETHER)
    before = Window.partitionBy("ticker", "__bucket").orderBy("ts", "event_id").rowsBetween(-VOLUME_DAYS, -1)
    rows = bars.withColumn("n", F.count("*").over(before)).withColumn("total", F.sum("volume_c").over(before)).where("NOT __carried")
    spike = F.when(F.col("n") == VOLUME_DAYS, F.col("volume_c") * VOLUME_DAYS > F.col("total") * VOLUME_TIMES)
    return rows.select("ticker", "ts", "event_id", "volume_c", spike.alias("spike"))


def checked(closes: Column, volumes: Column) -> tuple[Column, Column]:
    """(rsi, spike) of a ticker's last bars, as arrays in order: what rsi_series and volume_series give for the last of them."""
    n = F.size(closes)
    ends = F.slice(closes, F.greatest(n - RSI_PERIOD, F.lit(1)), RSI_PERIOD + 1)
    changes = F.transform(F.sequence(F.lit(1), F.lit(RSI_PERIOD)), lambda i: F.get(ends, i) - F.get(ends, i - 1))
    total = lambda up: F.aggregate(changes, F.lit(0).cast("long"), lambda s, x: s + F.greatest(x if up else -x, F.lit(0).cast("long")))
    gain, loss = total(True), total(False)
    rsi = F.when((n > RSI_PERIOD) & (loss > 0), 100 - 100 / (1 + (gain / 14.0) / F.when(loss > 0, loss / 14.0)))
    m = F.size(volumes)
    before = F.aggregate(F.slice(volumes, F.greatest(m - VOLUME_DAYS, F.lit(1)), VOLUME_DAYS), F.lit(0).cast("long"), lambda s, x: s + x)
    spike = F.when(m > VOLUME_DAYS, F.get(volumes, m - 1) * VOLUME_DAYS > before * VOLUME_TIMES)
    return rsi, spike


def latest_features(bars: DataFrame) -> DataFrame:
    """ticker, rsi, spike at each ticker's last bar, from its last 21; no more bars of a ticker leave a task. bars: (ticker, ts,
    event_id, close_c, volume_c)."""
    last = latest_k(bars.select("ticker", "ts", "event_id", "close_c", "volume_c"), "ticker", VOLUME_DAYS + 1, "ts", "event_id")
    rows = last.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "close_c", "volume_c"))).alias("b"))
    rsi, spike = checked(F.col("b.close_c"), F.col("b.volume_c"))
    return rows.select("ticker", rsi.alias("rsi"), spike.alias("spike"))


def sentiment_change(scores: DataFrame) -> DataFrame:
    """ticker, change: the latest score less the one before, whatever their age; none with a single score."""
    last = latest_k(scores.select("ticker", "ts", "id", "score"), "ticker", 2, "ts", "id")
    both = last.groupBy("ticker").agg(
        F.max(F.when(F.col("n") == 1, F.col("score"))).alias("now"),
        F.max(F.when(F.col("n") == 2, F.col("score"))).alias("before"),
    )
    return both.where("before IS NOT NULL").select("ticker", (F.col("now") - F.col("before")).alias("change"))


def stop_target(positions: DataFrame, live: DataFrame, limits: DataFrame, *more: str) -> DataFrame:
    """user_id, ticker, price, sl_price, tg_price of open positions with a live price, with the columns of live named in more."""
    rows = positions.where("quantity > 0").join(live, "ticker").join(limits, ["user_id", "ticker"], "left")
    return rows.select(
        "user_id",
        "ticker",
        "price",
        (F.col("avg_cost") * (1 - F.col("sl_pct") / 100)).alias("sl_price"),
        (F.col("avg_cost") * (1 + F.col("tg_pct") / 100)).alias("tg_price"),
        *more,
    )


def all_alerts(
    positions: DataFrame,
    live: DataFrame,
    limits: DataFrame,
    change: DataFrame,
    features: DataFrame,
    spikes: DataFrame | None = None,
) -> DataFrame:
    """user_id, ticker, alert_type, signal, message, price: every check in one pass over open positions. change, features and
    spikes hold one row for each ticker at most: (ticker, change), (ticker, rsi), (ticker, spike); features has both without spikes."""
    rows = stop_target(positions, live, limits).join(change, "ticker", "left").join(features, "ticker", "left")
    return alerts_of(rows if spikes is None else rows.join(spikes, "ticker", "left"))


def alerts_of(rows: DataFrame, *more: str, overbought: Column | None = None) -> DataFrame:
    """The alerts of rows (user_id, ticker, price, sl_price, tg_price, change, rsi, spike), with the columns named in more.
    overbought: the RSI above which to warn, where feedback has moved it."""
    overbought = F.lit(OVERBOUGHT) if overbought is None else overbought
    two = lambda c: F.format_string("%.2f", half_up(F.col(c)))
    one = F.format_string("%.1f", half_up(F.col("rsi"), 1))
    t = F.col("ticker")
    # Kinds, signals and message texts of alerts, in their order.
    checks = (
        (
            F.col("price") <= F.col("sl_price"),
            "STOP_LOSS_BREACH",
            "SELL",
            F.concat(t, F.lit(" down from your buy price. Stop-loss at "), two("sl_price"), F.lit(" breached.")),
        ),
        (
            F.col("price") >= F.col("tg_price"),
            "TARGET_HIT",
            "SELL",
            F.concat(t, F.lit(" up from your buy price. Target at "), two("tg_price"), F.lit(" hit.")),
        ),
        (
            F.col("change") < SENTIMENT_DROP,
            "SENTIMENT_CRASH",
            "CAUTION",
            F.concat(F.lit("Sudden drop in sentiment for "), t, F.lit(". Recent news is highly negative.")),
        ),
        (
            F.col("rsi") > overbought,
            "RSI_OVERBOUGHT",
            "SELL",
            F.concat(t, F.lit(" RSI is "), one, F.lit(" (Overbought). Consider booking profits.")),
        ),
        (
            F.col("rsi") < OVERSOLD,
            "RSI_OVERSOLD",
            "BUY",
            F.concat(t, F.lit(" RSI is "), one, F.lit(" (Oversold). Might be a good entry point.")),
        ),
        (
            F.col("spike"),
            "VOLUME_SPIKE",
            "HOLD",
            F.concat(F.lit("Unusual volume detected in "), t, F.lit(". Today's volume is >3x the 20-day average.")),
        ),
    )
    made = F.array_compact(
        F.array(
            *[
                F.when(c, F.struct(F.lit(kind).alias("alert_type"), F.lit(signal).alias("signal"), message.alias("message")))
                for c, kind, signal, message in checks
            ],
        ),
    )
    exploded = rows.select("user_id", "ticker", "price", *more, F.explode(made).alias("a"))
    return exploded.select("user_id", "ticker", "a.alert_type", "a.signal", "a.message", "price", *more)
