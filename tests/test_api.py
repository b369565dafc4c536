"""Endpoints and stored tables."""

from __future__ import annotations

import datetime as dt

import pytest

from ledgerloom.api import Advisor, wide_history
from ledgerloom.sources import schemas, tables
from ledgerloom.streaming import streams


@pytest.fixture(scope="module")
def advisor(spark, small):
    alerts = tables.alert_log(spark, small)
    feedback = spark.createDataFrame([(1, 1, True), (2, 1, False)], "alert_id long, user_id long, is_positive boolean")
    return Advisor(tables.users(spark, small), tables.trades(spark, small), tables.limits(spark, small), tables.ticks(spark, small), alerts, feedback)


def test_without_a_user_all_is_empty(advisor):
    assert advisor.holdings(None).count() == advisor.recent_trades(None).count() == advisor.inbox(None).count() == 0
    assert advisor.history(None, "2024-01-31 00:00:00").count() == 0
    assert tuple(advisor.unread(None).first()) == (0, "0")


def test_user_endpoints(advisor):
    user = advisor.trades.first().user_id
    held = advisor.holdings(user).collect()
    assert held and all(r.user_id == user and r.quantity > 0 for r in held)
    times = [r.ts for r in advisor.recent_trades(user).collect()]
    assert times == sorted(times, reverse=True) and len(times) <= 50
    assert advisor.history(user, "2024-01-31 00:00:00").count() > 0
    alert = advisor.alerts.where("NOT is_read").first()
    before = advisor.unread(alert.user_id).first().n
    after = advisor.mark_read(alert.user_id, alert.id).where(f"user_id = {alert.user_id} AND NOT is_read").count()
    assert after == before - 1


def test_limits_keep_what_is_not_asked(spark, advisor):
    one = advisor.limits.where("sl_pct IS NOT NULL").first()
    asked = spark.createDataFrame([(one.user_id, one.ticker, None, 77.0)], "user_id long, ticker string, sl_pct double, tg_pct double")
    got = advisor.set_limits(asked).where(f"user_id = {one.user_id} AND ticker = '{one.ticker}'").first()
    assert (got.sl_pct, got.tg_pct) == (one.sl_pct, 77.0)


def test_orders_send_balances(spark, advisor):
    user = advisor.users.first().id
    orders = spark.createDataFrame(
        [(1, user, "A", "BUY", 1.0, 10.0, dt.datetime(2024, 1, 1))],
        "id long, user_id long, ticker string, side string, quantity double, price double, ts timestamp_ntz",
    )
    payload = advisor.balance_events(advisor.order(orders)).first().payload
    assert payload.startswith('{"type":"balance_update","user_id":')


def test_wide_history(spark):
    rows = spark.createDataFrame([("t1", "A", 1.0), ("t1", "B", 2.0), ("t2", "A", 3.0)], "time string, ticker string, roi double")
    assert sorted(map(tuple, wide_history(rows, ["A", "B"]).collect())) == [("t1", 1.0, 2.0), ("t2", 3.0, None)]


def test_tables_are_created_appended_and_pruned(spark, tmp_path):
    root = str(tmp_path)
    schemas.create_tables(spark, root)
    rows = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, d), 1.0, 2.0, 0.5, 1.5, 10.0) for d in (1, 2)],
        "ticker string, timestamp timestamp, open double, high double, low double, close double, volume double",
    )
    schemas.append(rows, root, "ohlcv_data")
    schemas.create_tables(spark, root)
    assert schemas.load(spark, root, "ohlcv_data").count() == 2
    for name in schemas.SCHEMAS:
        assert [f.name for f in schemas.load(spark, root, name).schema] == [f.name for f in schemas.SCHEMAS[name]]


def test_restarted_streams_go_on(spark, tmp_path):
    """Rows that come between two runs are counted once."""
    source = f"{tmp_path}/in"
    for part in ([("a",), ("b",)], [("b",), ("c",)]):
        spark.createDataFrame(part, "text string").write.mode("append").parquet(source)
        stream = streams.unique_texts(spark.readStream.schema("text string").parquet(source))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation",
            f"{tmp_path}/log",
        ).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_late_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = [("a", dt.datetime(2024, 1, 1, 0)), ("a", dt.datetime(2024, 1, 1, 0, 30)), ("b", dt.datetime(2024, 1, 1, 1))]
    spark.createDataFrame(rows, "text string, ts timestamp").write.parquet(source)
    got = streams.run_append(streams.unique_recent_texts(spark.readStream.schema("text string, ts timestamp").parquet(source)))
    assert got.select("digest").distinct().count() == got.count() == 2


def test_periodic_streams_take_what_comes_and_go_on(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"
    for part in ([("a",), ("b",)], [("b",), ("c",)]):
        spark.createDataFrame(part, "text string").write.mode("append").parquet(source)
        q = streams.start_periodic(streams.unique_texts(spark.readStream.schema("text string").parquet(source)), folder, "1 second")
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{folder}/out").count() == 3
