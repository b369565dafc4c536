"""The proactive monitor as a stream: a state for each ticker, alerts of open positions after each batch, an optional cooldown.

TickerFeatures keeps, for each ticker, the sum of its changes, its last 21 bars and its last price; late bars take their place among
the bars that are kept, and the sum doesn't depend on order. The state ends when no bar has come for FORGOTTEN
(event time, by a timer). Each batch gives one row for each ticker that had a bar; it is joined to positions, limits and sentiment,
which are tables and are read anew for each batch, and the checks of the batch monitor follow.

Cooldown keeps, for each user, ticker and kind of alert, when one was last let through, in buckets: a bucket that gets alerts drops what
no longer holds anything back, and a timer clears one whose last entry doesn't, so its state is bounded by the alerts of two cooldowns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators import monitor
from ledgerloom.streaming.streams import DELAY, shared_folder

#: Days without a bar after which a ticker's state goes.
FORGOTTEN = 90
#: States of a cooldown at most; a checkpoint depends on it.
COOLDOWN_BUCKETS = 4096
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FEATURES = "ticker string, ts timestamp, price double, closes array<bigint>, volumes array<bigint>, n_bars bigint"
_MICROS = 1_000_000


def _micros(column: pd.Series) -> list[int]:
    return column.astype("datetime64[us]").astype("int64").tolist()


class TickerFeatures(StatefulProcessor):
    """After each batch: a ticker's last price and the closes and volumes of its last bars."""

    def __init__(self, bars: int, base: int, bars_before: int | None) -> None:
        self.bars, self.base, self.bars_before = bars, base, bars_before

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "at array<bigint>, id array<bigint>, change array<bigint>, volume array<bigint>")
        self.total = handle.getValueState("total", "total bigint, n bigint")
        self.last = handle.getValueState("last", "at bigint, id bigint, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ring = list(zip(*self.ring.get(), strict=True)) if self.ring.exists() else []
        total, n = self.total.get() if self.total.exists() else (0, 0)
        last = tuple(self.last.get()) if self.last.exists() else None
        heapq.heapify(ring)
        for t in rows:
            at, number = t.ts.to_numpy().astype("datetime64[us]").astype("int64"), t.event_id.to_numpy()
            newest = max(np.flatnonzero(at == at.max()), key=lambda i: number[i])
            if last is None or (at[newest], number[newest]) > last[:2]:
                last = (int(at[newest]), int(number[newest]), float(t.price.iloc[newest]))
            if self.bars_before is not None and not (inside := at < self.bars_before).all():
                t, at = t[inside], at[inside]
            total, n = total + int(t.change.sum()), n + len(at)
            if len(at) > self.bars:  # no others can be among the last
                late = at >= np.partition(at, -self.bars)[-self.bars]
                t, at = t[late], at[late]
            for x in zip(at.tolist(), t.event_id.tolist(), t.change.tolist(), t.volume.tolist(), strict=True):
                (heapq.heappush if len(ring) < self.bars else heapq.heappushpop)(ring, x)
        ring.sort()
        self.total.update((total, n))
        self.last.update(last)
        if ring:
            self.ring.update(tuple(list(c) for c in zip(*ring, strict=True)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last[0] // 1000 + FORGOTTEN * 86_400_000)
        closes, close = [], self.base + total
        for x in reversed(ring):
            closes.append(close)
            close -= x[2]
        yield pd.DataFrame(
            {
                "ticker": [key[0]],
                "ts": [pd.Timestamp(last[0] * 1000)],
                "price": [last[2]],
                "closes": [closes[::-1]],
                "volumes": [[x[3] for x in ring]],
                "n_bars": [n],
            },
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.ring, self.total, self.last):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Of the alerts of a user, ticker and kind in order of time, those that come so many seconds after the last one let through, or later.
    A state is that of a bucket of them: when each was last let through, as long as that holds anything back."""

    def __init__(self, seconds: int) -> None:
        self.wait = seconds * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "user_id array<string>, ticker array<string>, alert_type array<string>, at array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = []
        for t in rows:
            batch += zip(_micros(t.ts), t.id.tolist(), zip(t.user_id, t.ticker, t.alert_type, strict=True), strict=True)
        batch.sort(key=lambda x: x[:2])
        gone = timerValues.getCurrentWatermarkInMs() * 1000 - self.wait  # what was let through until then holds nothing back
        kept = self.passed.get() if self.passed.exists() else ((), (), (), ())
        last = {x[:3]: x[3] for x in zip(*kept, strict=True) if x[3] > gone}
        let = []
        for at, number, own in batch:
            if own not in last or at >= last[own] + self.wait:
                last[own] = at
                let.append((*own, at, number))
        self.passed.update(tuple(list(c) for c in zip(*((*own, at) for own, at in last.items()), strict=True)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((max(last.values()) + self.wait) // 1000 + 1)
        if let:
            users, tickers, kinds, at, ids = zip(*let, strict=True)
            yield pd.DataFrame(
                {
                    "user_id": pd.array([None if u is None else int(u) for u in users], dtype="Int64"),
                    "ticker": tickers,
                    "alert_type": kinds,
                    "ts": [pd.Timestamp(a * 1000) for a in at],
                    "id": ids,
                },
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.passed.clear()
        return iter(())

    def close(self) -> None:
        pass


def features(ticks: DataFrame, base: int = 0, bars_before: str | None = None) -> DataFrame:
    """ticker, ts, price, rsi, spike, n_bars after each batch, for the tickers that it brings. ticks: a stream of (ticker, ts, event_id,
    price, change, volume), a bar each; closes are base plus the sum of changes. bars_before: bars from that instant on
    count for the price only."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    until = None if bars_before is None else int(pd.Timestamp(bars_before).value // 1000)
    rows = ticks.select("ticker", "ts", "event_id", "price", "change", "volume").withWatermark("ts", DELAY)
    kept = rows.groupBy("ticker").transformWithStateInPandas(
        TickerFeatures(monitor.VOLUME_DAYS + 1, base, until),
        outputStructType=FEATURES,
        outputMode="Append",
        timeMode="EventTime",
    )
    rsi, spike = monitor.checked(F.col("closes"), F.col("volumes"))
    return kept.select("ticker", "ts", "price", rsi.alias("rsi"), spike.alias("spike"), "n_bars")


def alerts(found: DataFrame, positions: DataFrame, limits: DataFrame, change: DataFrame) -> DataFrame:
    """user_id, ticker, alert_type, signal, message, price, ts: the checks of every open position in the tickers of a batch of
    features. positions, limits and change are tables, one row for each user and ticker, or ticker."""
    rows = monitor.stop_target(positions, found, limits, "rsi", "spike", "ts")  # found once: a second use would run the state's step again
    return monitor.alerts_of(rows.join(change, "ticker", "left"), "ts")


def run_monitor(
    ticks: DataFrame,
    positions: DataFrame,
    limits: DataFrame,
    change: DataFrame,
    folder: str | None = None,
    base: int = 0,
    bars_before: str | None = None,
) -> DataFrame:
    """All alerts until the stream's input is taken. Each batch writes a folder of its own, so a batch that is repeated after a
    failure overwrites what it wrote; started again on the folder it goes on with the state that it had."""
    spark = ticks.sparkSession
    folder = folder or shared_folder(spark)
    schema = "user_id bigint, ticker string, alert_type string, signal string, message string, price double, ts timestamp"

    def step(batch: DataFrame, number: int) -> None:
        alerts(batch, positions, limits, change).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    stream = features(ticks, base, bars_before)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return read_batches(spark, folder, schema)


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches, with number, which batch they are of."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/out/number=-1")
    return spark.read.schema(f"{schema}, number bigint").parquet(f"{folder}/out")


def cooled(found: DataFrame, seconds: int) -> DataFrame:
    """user_id, ticker, alert_type, ts, id of the alerts that no alert of their user, ticker and kind let through has come before within so
    many seconds. found: a stream of these columns. Each state is a bucket of many users, tickers and kinds, as calls and states cost
    far more than rows; a bucket's alerts in one batch are sorted at once."""
    found.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = ("user_id", "ticker", "alert_type")
    rows = found.select(
        F.pmod(F.xxhash64(*own), F.lit(COOLDOWN_BUCKETS)).cast("int").alias("bucket"),
        F.col("user_id").cast("string").alias("user_id"),  # pandas makes doubles of numbers with nulls
        "ticker",
        "alert_type",
        "ts",
        "id",
    )
    return rows.withWatermark("ts", DELAY).groupBy("bucket").transformWithStateInPandas(
        Cooldown(seconds),
        outputStructType="user_id bigint, ticker string, alert_type string, ts timestamp, id bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
