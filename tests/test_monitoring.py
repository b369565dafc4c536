"""The streaming monitor: against the batch checks, over several batches, after a restart, with late bars; the cooldown."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import market, monitor
from ledgerloom.streaming import monitoring

BEGAN = datetime(2024, 1, 1)
BARS = "ticker string, ts timestamp, event_id long, price double, change long, volume long"


def bars(seed, n, tickers=3):
    r = random.Random(seed)
    out, at = [], BEGAN
    for i in range(n):
        at += timedelta(minutes=r.choice((0, 1, 1, 5)))
        out.append((f"T{r.randrange(tickers)}", at, i, r.randrange(50, 150) / 1.0, r.randrange(-500, 300), r.choice((10, 12, 14, 90))))
    return out


@pytest.fixture
def held(spark):
    positions = spark.createDataFrame([(u, f"T{t}", 1.0, 100.0) for u in (1, 2) for t in range(3)], "user_id long, ticker string, quantity double, avg_cost double")
    limits = spark.createDataFrame([(1, f"T{t}", 10.0, 10.0) for t in range(3)], "user_id long, ticker string, sl_pct double, tg_pct double")
    change = spark.createDataFrame([("T0", -0.5), ("T1", -0.1)], "ticker string, change double")
    return positions, limits, change


def expected(spark, given, held):
    """The batch checks over all bars that have come."""
    rows = spark.createDataFrame(given, BARS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    walk = market.running_sum(rows, ["ticker"], "ts", "event_id", F.col("change"), "1 day")
    features = monitor.latest_features(walk.select("ticker", "ts", "event_id", F.col("running").alias("close_c"), F.col("volume").alias("volume_c")))
    positions, limits, change = held
    return sorted(map(tuple, monitor.all_alerts(positions, market.live_price(rows), limits, change, features).collect()))


def written(spark, folder, number, given):
    spark.createDataFrame(given, BARS).coalesce(1).write.parquet(f"{folder}/in/{number}")


def stream(spark, folder):
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_each_batch_and_a_restart(spark, held, tmp_path):
    """Three runs on one folder, with late bars in the second; each one's last batch is the batch monitor over all bars so far."""
    folder, given = str(tmp_path), bars(1, 400)
    late = [given.pop(k) for k in (380, 371, 20)]
    parts = [given[:100], given[100:] + late, [(t, at + timedelta(days=1), i + 1000, p, c, v) for t, at, i, p, c, v in bars(2, 60)]]
    for number, part in enumerate(parts):
        written(spark, folder, number, part)
        found = monitoring.run_monitor(stream(spark, folder), *held, folder=folder)
        last = found.where(F.col("number") == found.agg(F.max("number")).first()[0]).drop("ts", "number")  # batches without input write no rows
        assert sorted(map(tuple, last.collect())) == expected(spark, sum(parts[: number + 1], []), held)
        assert found.select("number").distinct().count() == number + 1  # what earlier runs wrote stays


def test_a_ticker_without_bars_is_not_checked_again(spark, held, tmp_path):
    folder = str(tmp_path)
    written(spark, folder, 0, bars(3, 200))
    written(spark, folder, 1, [("T1", BEGAN + timedelta(days=2), 5000, 1.0, 5, 10)])
    found = monitoring.run_monitor(stream(spark, folder), *held, folder=folder)
    assert {r.ticker for r in found.where("number > 0").collect()} == {"T1"}


def test_forgotten_tickers_leave_no_state(spark, held, tmp_path):
    folder = str(tmp_path)
    days = lambda n: BEGAN + timedelta(days=n)
    for number, part in enumerate([[("A", days(0), 1, 1.0, 5, 1)], [("B", days(200), 2, 1.0, 5, 1)], [("B", days(201), 3, 1.0, 5, 1)], [("A", days(202), 4, 1.0, 7, 1)]]):
        written(spark, folder, number, part)
        monitoring.features(stream(spark, folder)).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation",
            f"{folder}/log",
        ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").orderBy("ts").collect()
    assert [(r.ticker, r.n_bars) for r in rows] == [("A", 1), ("B", 1), ("B", 2), ("A", 1)]


def test_cooldown(spark, tmp_path):
    r = random.Random(4)
    schema = "user_id long, ticker string, alert_type string, ts timestamp, id long"
    rows = [(r.randrange(3), f"T{r.randrange(2)}", r.choice("ab"), BEGAN + timedelta(minutes=r.randrange(3000)), i) for i in range(400)]
    rows.sort(key=lambda x: x[3])
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    monitoring.cooled(given, 3600).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation",
        f"{tmp_path}/log",
    ).trigger(availableNow=True).start().awaitTermination()
    want, last = [], {}
    for u, t, a, at, i in sorted(rows, key=lambda x: (x[3], x[4])):
        if (u, t, a) not in last or at >= last[u, t, a] + timedelta(hours=1):
            last[u, t, a] = at
            want.append(i)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)


def test_cooldown_states_are_buckets(spark, tmp_path, monkeypatch):
    """Hundreds of users keep a few states, over several batches; ids of any length and alerts without a user are as others."""
    monkeypatch.setattr(monitoring, "COOLDOWN_BUCKETS", 8, raising=False)
    r = random.Random(5)
    schema = "user_id long, ticker string, alert_type string, ts timestamp, id long"
    users = [None, *[2**60 + i for i in range(150)]]
    rows = sorted(((r.choice(users), "T", r.choice("ab"), BEGAN + timedelta(minutes=r.randrange(600)), i) for i in range(900)), key=lambda x: x[3:])
    for n in range(3):
        spark.createDataFrame(rows[n * 300 : n * 300 + 300], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = monitoring.cooled(given, 86400).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 8 * 3
    want = {}
    for u, _, a, _, i in rows:
        want.setdefault((u, a), i)
    assert sorted((r.user_id or 0, r.alert_type, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted((u or 0, a, i) for (u, a), i in want.items())


def test_only_latest_mentions_are_scored(spark, small, monkeypatch):
    """Two scores a ticker make the change, so no other text is scored."""
    from ledgerloom.operators import news
    from ledgerloom.plans import monitor as plans

    scored, given = news.scored, []
    monkeypatch.setattr(news, "scored", lambda articles, *more: given.append(articles.count()) or scored(articles, *more))
    want = {
        r.ticker: r.change
        for r in monitor.sentiment_change(plans.sentiment_scores(spark, small).where(F.col("ts") <= F.lit(plans.SCORES_UNTIL).cast("timestamp_ntz"))).collect()
    }
    given.clear()
    kept = plans._ticker_number(spark, small)
    assert given and given[0] <= 2 * len(plans.src.KEYWORDS)
    got = {r.change for r in kept.collect()}
    assert want and got <= set(want.values())


def test_many_bars_of_a_batch(spark, held, tmp_path):
    """More bars of a ticker than are kept, many of them at one instant."""
    folder, given = str(tmp_path), [(t, BEGAN + timedelta(minutes=i // 30), i, p, c, v) for t, _, i, p, c, v in bars(6, 1500)]
    written(spark, folder, 0, given)
    found = monitoring.run_monitor(stream(spark, folder), *held, folder=folder)
    assert sorted(map(tuple, found.drop("ts", "number").collect())) == expected(spark, given, held)
