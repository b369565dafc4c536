"""Physical plans: what must aggregate by hash, scan once and keep few rows."""

from __future__ import annotations

import pytest

from ledgerloom.plans import registry

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["live_price", "ohlcv_bars_1h", "dedupe_md5", "holdings_valuation", "avg_cost_positions"])
def test_hash_aggregates(spark, small, name):
    found = plan(QUERIES[name](spark, small))
    assert "HashAggregate" in found and "SortAggregate" not in found


def test_articles_of_all_sources_in_one_scan(spark, small):
    assert plan(QUERIES["articles_union"](spark, small)).count("FileScan") == 1
    df = QUERIES["articles_union"](spark, small)
    assert df.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_null_and_unknown_sources_stay(spark):
    from ledgerloom.operators import news

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "seq long, source string")
    ranks = spark.createDataFrame([("a", 4)], "source string, source_rank int")
    assert sorted((r.seq, r.source_rank) for r in news.ranked_by_source(rows, ranks).collect()) == [(1, 4), (2, None), (3, None)]


def test_dedupe_keeps_one_null_and_the_first_of_each(spark):
    from ledgerloom.operators import news

    rows = spark.createDataFrame([(5, "x"), (2, "x"), (3, None), (1, None), (4, "y"), (6, "")], "seq long, text string")
    assert sorted(r.seq for r in news.first_of_each(rows).collect()) == [1, 2, 4, 6]


def test_latest_features_equal_the_series(spark, small):
    from pyspark.sql import functions as F

    from ledgerloom.operators import monitor
    from ledgerloom.plans.monitor import walk_bars

    bars = walk_bars(spark, small)
    last = lambda rows, c: {r.ticker: r[c] for r in rows.groupBy("ticker").agg(F.max_by(c, F.struct("ts", "event_id")).alias(c)).collect()}
    for given in (bars, bars.where("event_id % 50 < 12"), bars.where("event_id % 50 < 14")):
        got = monitor.latest_features(given).collect()
        assert {r.ticker: r.rsi for r in got} == last(monitor.rsi_series(given), "rsi")
        assert {r.ticker: r.spike for r in got} == last(monitor.volume_series(given), "spike")
