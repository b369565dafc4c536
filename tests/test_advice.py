"""Queries that did less than their whole job, over small tables made for the purpose."""

from __future__ import annotations

import datetime as dt
import json

from ledgerloom.operators import positions
from ledgerloom.plans import market, monitor, news


def test_chart_buffer_keeps_2000_ticks(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=i), 1, "view", 1.0, '{"k": 3}') for i in range(2100)]
    spark.createDataFrame(
        rows,
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id for r in market.chart_buffer(spark, str(tmp_path)).collect()}
    assert got == set(range(100, 2100))


def test_feedback_tuning_needs_100_ratings_and_70_percent(spark, tmp_path):
    sizes = ((100, 70), (99, 99), (100, 69), (200, 140), (30, 30))  # ratings and negative ones of alert types 0 to 4
    rows = [(6 * i + k, int(i >= bad), 0) for k, (n, bad) in enumerate(sizes) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.alert_type: (r.n, r.bad, r.threshold) for r in monitor.feedback_tuning(spark, str(tmp_path)).collect()}
    assert [got[t] for t in monitor.src.ALERT_TYPES[:5]] == [(100, 70, 80), (99, 99, 75), (100, 69, 75), (200, 140, 80), (30, 30, 75)]


def test_article_text_is_whole(spark, tmp_path):
    spark.createDataFrame([(1, 2, "user", "x" * 100)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.article for r in news.article_text(spark, str(tmp_path)).collect()] == ["user. " + "x" * 100]


def test_every_source_is_united(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source").collect()
    assert sorted((r.doc_id, int(r.source[3:])) for r in rows) == sorted((r.seq, r.source_rank) for r in news.articles_union(spark, small).collect())


def test_every_user_gets_messages(spark, small):
    users = {r.id for r in monitor.src.users(spark, small).collect()}
    prices = {r.ticker: r.price for r in market.live_price(spark, small).collect()}
    alerts = [r for r in monitor.src.alert_log(spark, small).collect() if r.user_id in users and r.user_id > 0]
    want = [(u, c, "price_update", f'{{"ticker":"{t}","price":{p}}}') for u in users for c in "ab" for t, p in prices.items()]
    want += [
        (
            r.user_id,
            c,
            "alert",
            json.dumps({k: r[k] for k in ("user_id", "alert_type", "ticker", "message", "signal")}, separators=(",", ":")),
        )
        for r in alerts
        for c in "ab"
    ]
    assert sorted(tuple(r) for r in monitor.ws_route(spark, small).collect()) == sorted(want)


def test_average_cost_collects_no_array(spark, small):
    plan = positions.average_cost(monitor.src.trades(spark, small))._jdf.queryExecution().toString().lower()
    assert "collect_list" not in plan and "max_by" in plan


def test_more_alerts_have_their_kinds(spark, small):
    from ledgerloom.plans import analytics

    rows = analytics.more_alerts(spark, small).collect()
    kinds = {r.alert_type for r in rows}
    assert {"CONCENTRATION_RISK", "SECTOR_OVERWEIGHT", "PORTFOLIO_FLAT"} <= kinds <= set(analytics.MORE_ALERTS)
    assert all(r.priority == analytics.MORE_ALERTS[r.alert_type] for r in rows)


def test_prices_expire_without_ticks(spark, tmp_path):
    """A's last tick is two hours before B's: its price has expired, B's lives."""
    from ledgerloom.streaming import streams

    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "A", 1.0), (2, at + dt.timedelta(minutes=1), "A", 2.0), (3, at + dt.timedelta(hours=3), "B", 5.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, ticker string, price double").coalesce(1).write.parquet(f"{tmp_path}/in")
    ticks = spark.readStream.schema("event_id long, ts timestamp, ticker string, price double").parquet(f"{tmp_path}/in")
    got = sorted((r.ticker, r.price, r.live) for r in streams.run_append(streams.expiring_prices(ticks)).collect())
    assert got == [("A", 2.0, False), ("A", 2.0, True), ("B", 5.0, True)]
