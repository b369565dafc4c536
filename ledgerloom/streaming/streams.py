"""Structured Streaming forms of the advisor's feeds.

Feeds read files as a stream (a message bus has the same plan behind another source), run until all input is taken
(availableNow) and write Parquet under the shared checkpoint folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.market import instant
from ledgerloom.operators.trading import RESULT, executed
from ledgerloom.sources.tables import ALERT_MESSAGE, ALERT_SIGNALS, ALERT_TYPES, pick

#: How late events may come.
DELAY = "1 hour"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir; with a local master, a temporary one where
    none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="streams-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (timestamp, so that it can carry a watermark), user_id, ticker, price, event_type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return feed(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.concat(F.lit("T"), (k % 20).cast("string")).alias("ticker"),
        F.col("value").alias("price"),
        "event_type",
    )


def start_periodic(stream: DataFrame, folder: str, every: str) -> StreamingQuery:
    """Starts an append-mode query that takes what has come once every interval ("1 minute"), until it is stopped; rows go to
    folder/out, exactly once, and a query started again on the folder goes on."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
    return writer.trigger(processingTime=every).start()


def run_append(stream: DataFrame) -> DataFrame:
    """Rows of an append-mode query, exactly once, by the file sink."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation",
        f"{path}/log",
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_complete(stream: DataFrame) -> DataFrame:
    """The last state of a complete-mode query. Each batch writes a folder of its own; a repeated batch overwrites it."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{number}")
        seen.append(number)

    stream.writeStream.outputMode("complete").foreachBatch(write).option(
        "checkpointLocation",
        f"{path}/log",
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/{max(seen)}") if seen else spark.createDataFrame([], stream.schema)


def bars(ticks: DataFrame, interval: str) -> DataFrame:
    """Bars of closed windows only: a window closes when an event comes that is later than its end by DELAY."""
    at = instant()
    rows = ticks.withWatermark("ts", DELAY).groupBy("ticker", F.window("ts", interval).alias("w"))
    made = rows.agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return made.select("ticker", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def live_prices(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("ticker").agg(F.max_by("price", instant()).alias("price"))


def unique_texts(articles: DataFrame) -> DataFrame:
    """digest of every text once. The state holds a digest for each text, in the state store."""
    return articles.select(F.md5("text").alias("digest")).dropDuplicates(["digest"])


def unique_recent_texts(articles: DataFrame) -> DataFrame:
    """The same with bounded state: a text that comes again later than DELAY passes again. articles: (text, ts)."""
    return articles.select(F.md5("text").alias("digest"), "ts").withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["digest"])


def alert_payloads(ticks: DataFrame) -> DataFrame:
    """user_id and JSON message of error events, as alerts, routed by user."""
    kind = F.col("event_id") % 6
    rows = ticks.where("event_type = 'error' AND user_id > 0").withColumn("alert_type", pick(ALERT_TYPES, kind)).withColumn("signal", pick(ALERT_SIGNALS, kind))
    rows = rows.withColumn("message", F.concat("ticker", F.lit(": "), "alert_type"))
    return rows.select("user_id", F.to_json(F.struct(*ALERT_MESSAGE)).alias("payload"))


def run_orders(orders: DataFrame, ticks: DataFrame, balance: float, merge_every: int = 20) -> DataFrame:
    """Outcomes of orders executed as they come. orders: (id, user_id, ticker, side, quantity, price, ts), a stream; ticks:
    the table of ticks (ticker, ts, event_id, price) that holds all up to the orders' times.

    Each batch folds its orders onto the accounts that the batches before have left, as tables: users stream through sorted
    partitions, so a batch may hold any number of a user's orders. A batch writes the accounts that it changed, and one of
    so many batches those of all users. A repeated batch overwrites its own folders only, so results are exact after a restart."""
    spark, path = orders.sparkSession, shared_folder(orders.sparkSession)
    result = T.StructType.fromDDL(RESULT)
    accounts = T.StructType.fromDDL("user_id bigint, balance double, held string, number bigint")

    def accounts_before(number: int) -> DataFrame:
        since = (number - 1) // merge_every * merge_every
        folders = [f"{path}/accounts/{n}" for n in range(since, number)] if number else []
        rows = spark.read.schema(accounts).parquet(*folders) if folders else spark.createDataFrame([], accounts)
        latest = F.max_by(F.struct("balance", "held"), "number")
        return rows.groupBy("user_id").agg(latest.alias("a")).select("user_id", "a.*")

    def step(batch: DataFrame, number: int) -> None:
        before = accounts_before(number)
        users = batch.select("user_id").distinct().join(before, "user_id", "left").withColumn("balance", F.coalesce("balance", F.lit(balance)))
        executed(batch, users, ticks).write.mode("overwrite").parquet(f"{path}/batch/{number}")
        done = spark.read.parquet(f"{path}/batch/{number}")
        after = done.where("status = 'STATE'").select("user_id", F.col("virtual_balance_after").alias("balance"), F.col("state").alias("held"))
        if number % merge_every == 0:
            after = before.join(after, "user_id", "left_anti").unionByName(after)
        after.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/accounts/{number}")
        done.where("status <> 'STATE'").select(*result.names).write.mode("overwrite").parquet(f"{path}/out/number={number}")

    orders.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], result).write.mode("append").parquet(f"{path}/out/number=-1")
    return spark.read.schema(result).parquet(f"{path}/out").select(*result.names)


def expiring_prices(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """ticker, price, ts, live: after each batch, a ticker's latest price; and once more, no longer live, when no tick has come
    for so many seconds (event time, by the watermark): its state is then gone."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            price, ts, _ = state.get
            state.remove()
            yield pd.DataFrame({"ticker": [key[0]], "price": [price], "ts": [ts], "live": [False]})
            return
        last = state.get if state.exists else None
        for t in batches:
            t = t.sort_values(["ts", "event_id"]).iloc[-1]
            if last is None or (t.ts, t.event_id) > (last[1], last[2]):
                last = (float(t.price), t.ts.to_pydatetime(), int(t.event_id))
        state.update(last)
        state.setTimeoutTimestamp(max(int(last[1].timestamp() * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"ticker": [key[0]], "price": [last[0]], "ts": [last[1]], "live": [True]})

    rows = ticks.select("ticker", "price", "ts", "event_id").withWatermark("ts", DELAY)
    kept = "price double, ts timestamp, event_id bigint"
    return rows.groupBy("ticker").applyInPandasWithState(
        step,
        "ticker string, price double, ts timestamp, live boolean",
        kept,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
