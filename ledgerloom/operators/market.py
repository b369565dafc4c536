"""Market data: live prices, bars, tracked tickers, as-of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import BASELINE_INDICES, DEFAULT_TICKERS


def instant(time: str = "ts", order: str = "event_id") -> Column:
    """Time and then order as one number, by which max_by and min_by aggregate by hash; a struct there makes them sort."""
    return F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(38,0)") * F.lit("20000000000000000000").cast("decimal(20,0)") + F.col(order)


def live_price(ticks: DataFrame) -> DataFrame:
    """ticker, price: the latest tick of each ticker; one aggregate with map-side combination."""
    return ticks.groupBy("ticker").agg(F.max_by("price", instant()).alias("price"))


def fresh_price(ticks: DataFrame, now: str, seconds: int) -> DataFrame:
    """live_price of ticks not older than so many seconds at an instant."""
    at = F.lit(now).cast("timestamp_ntz")
    return live_price(ticks.where((F.col("ts") <= at) & (F.col("ts") > at - F.expr(f"INTERVAL {seconds} SECONDS"))))


def latest_price(quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """ticker, price: a positive quote, else the last bar's close, else null. quotes: (ticker, quote)."""
    last = bars.groupBy("ticker").agg(F.max_by("close", "bar_ts").alias("close"))
    return quotes.join(last, "ticker", "left").select("ticker", F.coalesce(F.when(F.col("quote") > 0, F.col("quote")), F.col("close")).alias("price"))


def bars(ticks: DataFrame, interval: str) -> DataFrame:
    """ticker, bar_ts, open, high, low, close, volume (ticks) of tumbling windows."""
    at = instant()
    window = F.window(F.col("ts"), interval)
    return (
        ticks.groupBy("ticker", window.alias("w")) .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        ) .select("ticker", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
    )


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored plus the incoming rows whose key is new; of several with one key the first by order."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def tracked_tickers(held: DataFrame) -> DataFrame:
    """ticker: held ones and the baseline indices; the default tickers if nothing else is held."""
    spark = held.sparkSession
    own = held.select("ticker").unionByName(spark.createDataFrame([(t,) for t in BASELINE_INDICES], "ticker string")).distinct()
    others = own.where(~F.col("ticker").isin(*BASELINE_INDICES)).agg((F.count("*") > 0).alias("some"))
    fallback = spark.createDataFrame([(t,) for t in DEFAULT_TICKERS], "ticker string")
    flagged = own.withColumn("own", F.lit(True)).unionByName(fallback.withColumn("own", F.lit(False)))
    return flagged.join(F.broadcast(others), F.col("own") == F.col("some")).select("ticker")


def latest_k(rows: DataFrame, key: str | list[str], k: int, *order: str) -> DataFrame:
    """The k latest rows of each key; Spark prunes within tasks before the shuffle."""
    by = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k)


def running_sum(rows: DataFrame, keys: list[str], time: str, order: str, value: Column, bucket: str) -> DataFrame:
    """rows with running: the sum of value over the rows of their keys up to each, by time and order. Each bucket of time adds up
    by itself, on top of the sum of the buckets before, so that few keys with very many rows keep all tasks busy."""
    rows = rows.withColumn("__bucket", F.window(time, bucket)["start"]).withColumn("__value", value)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__sum"))
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__bucket").orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__within", F.sum("__value").over(within)).join(sums, [*keys, "__bucket"])
    return out.withColumn("running", F.col("__before") + F.col("__within")).drop("__bucket", "__value", "__before", "__within")


def with_rows_before(rows: DataFrame, keys: list[str], time: str, order: str, k: int, bucket: str) -> DataFrame:
    """rows with __bucket and __carried: each bucket of time also holds the k rows of its keys before it, as carried ones, so that
    frames of k rows can be computed by bucket. At most k rows of a bucket, and one row for each bucket, meet by key."""
    rows = rows.withColumn("__bucket", F.window(time, bucket)["start"])
    row = F.struct(time, order, *[c for c in rows.columns if c not in (time, order, "__bucket", *keys)])
    last = latest_k(rows, [*keys, "__bucket"], k, time, order).groupBy(*keys, "__bucket").agg(F.sort_array(F.collect_list(row)).alias("__last"))
    by = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(-k, -1)
    before = last.select(*keys, "__bucket", F.flatten(F.collect_list("__last").over(by)).alias("__before"))
    before = before.select(*keys, "__bucket", F.explode(F.slice("__before", F.greatest(F.size("__before") - k + 1, F.lit(1)), k)).alias("__row"))
    before = before.select(*keys, "__bucket", "__row.*", F.lit(True).alias("__carried"))
    return rows.withColumn("__carried", F.lit(False)).unionByName(before)


def with_span_before(rows: DataFrame, time: str, span: str, bucket: str) -> DataFrame:
    """rows with __bucket and __carried: each bucket of time also holds the rows of the span before it, as carried ones, so that
    frames of that span can be computed by bucket. A bucket is at least as long as the span."""
    own = F.window(time, bucket)["start"]
    reached = rows.withColumn("__own", own).withColumn("__until", F.col(time) + F.expr(f"INTERVAL {span}"))
    reached = reached.withColumn("__next", F.window("__until", bucket)["start"])
    copies = reached.withColumn("__bucket", F.explode(F.array_distinct(F.array("__own", "__next"))))
    return copies.withColumn("__carried", F.col("__bucket") != F.col("__own")).drop("__own", "__until", "__next")


def carried_in(left: DataFrame, right: DataFrame, keys: list[str], time: str, bucket: str) -> DataFrame:
    """(keys, time, __value) with the latest __value of right before each bucket of time that left has rows in; time is the
    bucket's start. One row for each bucket meets in a window, however many rows the bucket has."""
    start = F.window(time, bucket)["start"]
    last = right.groupBy(*keys, start.alias("__bucket")).agg(F.max_by("__value", F.struct(time, "__order")).alias("__value"))
    asked = left.select(*keys, start.alias("__bucket")).distinct().withColumn("__value", F.lit(None).cast(right.schema["__value"].dataType))
    each = last.unionByName(asked).groupBy(*keys, "__bucket").agg(F.first("__value", ignorenulls=True).alias("__value"))
    by = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, F.col("__bucket").alias(time), F.last("__value", ignorenulls=True).over(by).alias("__value")).where("__value IS NOT NULL")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], order: str, bucket: str | None = None) -> DataFrame:
    """left with the values of the latest right row of its keys at or before its time. One shuffle and one sort: both
    sides are stacked and the last known values carried on; rows of right with equal times go by order. bucket: where keys
    are few and have very many rows, each such span of time is a partition of its own, which starts with the latest value
    before it."""
    stacked = right.select(
        *keys,
        time,
        F.lit(0).alias("__side"),
        F.col(order).cast("long").alias("__order"),
        F.struct(*values).alias("__value"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"),
    )
    stacked = stacked.unionByName(
        left.select(
            *keys,
            time,
            F.lit(1).alias("__side"),
            F.lit(0).cast("long").alias("__order"),
            F.lit(None).cast(stacked.schema["__value"].dataType).alias("__value"),
            F.struct(*left.columns).alias("__row"),
        ),
    )
    parts = list(keys)
    if bucket:
        only = stacked.where("__side = 0")
        before = carried_in(left, only, keys, time, bucket)
        empty = {c: F.lit(None).cast(stacked.schema[c].dataType).alias(c) for c in ("__order", "__row")}
        before = before.select(*keys, time, F.lit(-1).alias("__side"), empty["__order"], "__value", empty["__row"])
        stacked = stacked.unionByName(before).withColumn("__bucket", F.window(time, bucket)["start"])
        parts.append("__bucket")
    by = Window.partitionBy(*parts).orderBy(time, "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.withColumn("__last", F.last("__value", ignorenulls=True).over(by)).where("__side = 1")
    return carried.select("__row.*", *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])
