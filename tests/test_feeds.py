"""Provider files, as collectors leave them."""

from __future__ import annotations

import datetime as dt
import json

from ledgerloom.operators import market, news
from ledgerloom.sources import feeds


def test_search_responses(spark, tmp_path):
    folder = tmp_path / "search"
    folder.mkdir()
    made = [{"title": f"t{i}", "description": None if i == 1 else f"d{i}", "publishedAt": "2024-01-29T23:00:00Z", "url": "x"} for i in range(12)]
    (folder / "a.json").write_text(json.dumps({"status": "ok", "totalResults": 12, "articles": made}, indent=1))
    (folder / "b.json").write_text(json.dumps({"status": "error", "articles": made}))
    (folder / "c.json").write_text("{not json")
    (folder / "d.json").write_text(json.dumps({"status": "ok", "articles": []}))
    got = sorted(tuple(r) for r in feeds.search_articles(spark, str(folder), "Search").collect())
    assert len(got) == 10
    assert got[:3] == [(t, "Search", dt.datetime(2024, 1, 29, 23)) for t in ("t0. d0", "t1. None", "t2. d2")]


def test_rss_items(spark, tmp_path):
    items = (
        "<item><title>Old &amp; done</title><description>x</description><pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate></item>"
        "<item><title>New</title><description>y</description><pubDate>Tue, 30 Jan 2024 04:30:00 +0530</pubDate></item>"
        "<item><title>Undated</title></item>"
        "<item><title>Odd</title><pubDate>soon</pubDate></item>"
    )
    (tmp_path / "feed.xml").write_text(f'<?xml version="1.0"?><rss version="2.0"><channel><title>all</title>{items}</channel></rss>')
    rows = feeds.rss_articles(spark, str(tmp_path / "feed.xml"), "Feed")
    got = {r.text: r.published for r in rows.collect()}
    assert got == {"Old & done. x": dt.datetime(2024, 1, 29, 10), "New. y": dt.datetime(2024, 1, 29, 23), "Undated. ": None, "Odd. ": None}
    assert {r.text for r in feeds.recent(rows, "2024-01-30 00:00:00").collect()} == {"New. y", "Undated. ", "Odd. "}


def test_sources_unite_in_order(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"status": "ok", "articles": [{"title": "same", "description": "text", "publishedAt": None}]}))
    (tmp_path / "b.xml").write_text("<rss><channel><item><title>same</title><description>text</description></item></channel></rss>")
    both = news.union_sources(feeds.search_articles(spark, str(tmp_path / "a.json"), "Search"), feeds.rss_articles(spark, str(tmp_path / "b.xml"), "Feed"))
    kept = news.first_of_each(both.withColumnRenamed("source_rank", "seq")).collect()
    assert [(r.text, r.source) for r in kept] == [("same. text", "Search")]


def test_price_frames_go_in_once(spark, tmp_path):
    for ticker, close in (("A.NS", 1.5), ("B.NS", 2.5)):
        folder = tmp_path / f"ticker={ticker}"
        folder.mkdir()
        (folder / "1d.csv").write_text(
            (
                f"Datetime,Open,High,Low,Close,Volume\n2024-01-29 00:00:00+05:30,1,2,0.5,{close},10\n2024-01-30 "
                f"00:00:00+05:30,1,2,0.5,,10\nsoon,1,2,0.5,1,10\n"
            ),
        )
    rows = feeds.price_frames(spark, str(tmp_path))
    first = dt.datetime(2024, 1, 28, 18, 30)
    assert sorted((r.ticker, r.timestamp, r.close, r.volume) for r in rows.collect()) == [("A.NS", first, 1.5, 10.0), ("B.NS", first, 2.5, 10.0)]
    stored = rows.where("ticker = 'A.NS'").selectExpr("ticker", "timestamp", "open", "high", "low", "9.0D AS close", "volume")
    after = market.insert_if_absent(stored, rows, ["ticker", "timestamp"], "close")
    assert sorted((r.ticker, r.close) for r in after.collect()) == [("A.NS", 9.0), ("B.NS", 2.5)]
