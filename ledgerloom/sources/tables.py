"""Tables and the views that the portfolio queries derive from them.

Each view is a DataFrame function of (spark, sf_dir) and, under the same name in VIEWS, a DuckDB statement of the same
rows; with_views() puts the statements that a query needs in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults and tickers of the advisor.
START_BALANCE, TRADING_BALANCE = 100000.0, 4000.0
BASELINE_INDICES = ("^NSEI", "^BSESN")
DEFAULT_TICKERS = ("RELIANCE.NS", "TCS.NS", "INFY.NS", "^NSEI", "^BSESN")
KEYWORDS = ("ITC.NS", "LT.NS", "ERING.NS", "ONING.NS", "THING.NS", "^NSEI")
LEXICON = {"thing": 1.5, "ering": -1.5, "oning": -0.8, "the": 0.1, "and": 0.05, "by": -0.1}
ALERT_TYPES = ("STOP_LOSS_BREACH", "TARGET_HIT", "SENTIMENT_CRASH", "RSI_OVERBOUGHT", "RSI_OVERSOLD", "VOLUME_SPIKE")
#: The fields of an alert's message, in their order.
ALERT_MESSAGE = ("user_id", "alert_type", "ticker", "message", "signal")
ALERT_SIGNALS = ("SELL", "SELL", "CAUTION", "SELL", "BUY", "HOLD")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("bigint")


def pick(values: tuple, index: Column) -> Column:
    """values[index] for a non-negative index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, ticker, price, price_c, k, event_type: every event is a tick of one of 20 tickers."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit("T"), (k % 20).cast("string")).alias("ticker"),
        F.col("value").alias("price"),
        cents(F.col("value")).alias("price_c"),
        k.alias("k"),
        "event_type",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, ticker, side, quantity, fill_price, ts: purchases and signups buy, errors sell."""
    side = F.when(F.col("event_type") == "error", "SELL").otherwise("BUY")
    return ticks(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup", "error")).select(
        F.col("event_id").alias("id"),
        "user_id",
        "ticker",
        side.alias("side"),
        (F.lit(1) + F.col("event_id") % 10).cast("double").alias("quantity"),
        F.col("price").alias("fill_price"),
        "ts",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, email, name, virtual_balance of users with events."""
    ids = read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return ids.join(names, "id").select("id", F.concat("name", F.lit("@example.com")).alias("email"), "name", F.lit(START_BALANCE).alias("virtual_balance"))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ticker, sl_pct, tg_pct of traded pairs; every seventh user has none."""
    has = F.col("user_id") % 7 != 0
    return trades(spark, sf_dir).select("user_id", "ticker").distinct().select(
        "user_id",
        "ticker",
        F.when(has, (5 + F.col("user_id") % 3 * 5).cast("double")).alias("sl_pct"),
        F.when(has, (10 + F.col("user_id") % 4 * 5).cast("double")).alias("tg_pct"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, source, text, published: documents as news; every 17th is undated."""
    published = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 240).cast("int"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        "source",
        "text",
        F.when(F.col("doc_id") % 17 != 0, published).alias("published"),
    )


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, ticker, alert_type, message, signal, price_at_alert, is_read, created_at: error events as alerts."""
    kind, rows = F.col("event_id") % 6, ticks(spark, sf_dir).where("event_type = 'error'")
    message = F.concat("ticker", F.lit(": "), pick(ALERT_TYPES, kind))
    return rows.select(
        F.col("event_id").alias("id"),
        "user_id",
        "ticker",
        pick(ALERT_TYPES, kind).alias("alert_type"),
        message.alias("message"),
        pick(ALERT_SIGNALS, kind).alias("signal"),
        F.col("price").alias("price_at_alert"),
        (F.col("k") % 2 == 0).alias("is_read"),
        F.col("ts").alias("created_at"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alert_id, alert_type, is_positive."""
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("alert_id"),
        pick(ALERT_TYPES, F.col("doc_id") % 6).alias("alert_type"),
        (F.col("quality") == 1).alias("is_positive"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alert_id, alert_type, is_positive, user_id: ratings with their sender, the user of the event with that id; every third
    comes from another one."""
    sender = F.col("user_id") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    senders = read(spark, sf_dir, "events").select(F.col("event_id").alias("alert_id"), sender.alias("user_id"))
    return ratings(spark, sf_dir).join(senders, "alert_id", "left")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, ticker, signal, price_at_signal, created_at: clicks as signals."""
    return ticks(spark, sf_dir).where("event_type = 'click'").select(
        F.col("event_id").alias("id"),
        "user_id",
        "ticker",
        pick(("BUY", "SELL", "HOLD"), F.col("event_id") % 3).alias("signal"),
        F.col("price").alias("price_at_signal"),
        F.col("ts").alias("created_at"),
    )


def _values(items: tuple | list) -> str:
    return ", ".join(f"'{x}'" for x in items)


# in v_folded, the average-cost fold, an element is {d: signed quantity, p: price, q: held, a: average cost}
VIEWS = {
    "v_ticks": (
        "SELECT event_id, ts, user_id, 'T' || (k % 20) AS ticker, value AS price, CAST(round(value * 100) AS BIGINT) AS price_c, k, "
        "event_type FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
    ),
    "v_trades": (
        "SELECT event_id AS id, user_id, ticker, CASE WHEN event_type = 'error' THEN 'SELL' ELSE 'BUY' END AS side, CAST(1 + event_id % 10 "
        "AS DOUBLE) AS quantity, price AS fill_price, ts FROM v_ticks WHERE event_type IN ('purchase', 'signup', 'error')"
    ),
    "v_users": (
        f"SELECT e.id, c_name || '@example.com' AS email, c_name AS name, CAST({START_BALANCE} AS DOUBLE) AS virtual_balance FROM (SELECT "
        f"DISTINCT user_id AS id FROM events) e JOIN customer ON c_custkey = e.id"
    ),
    "v_limits": (
        "SELECT DISTINCT user_id, ticker, CASE WHEN user_id % 7 <> 0 THEN CAST(5 + user_id % 3 * 5 AS DOUBLE) END AS sl_pct, CASE WHEN "
        "user_id % 7 <> 0 THEN CAST(10 + user_id % 4 * 5 AS DOUBLE) END AS tg_pct FROM v_trades"
    ),
    "v_articles": (
        "SELECT doc_id AS seq, source, text, CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-30 00:00:00' - to_minutes(CAST(doc_id % "
        "240 AS INT)) END AS published FROM documents"
    ),
    "v_alerts": (
        f"SELECT event_id AS id, user_id, ticker, ([{_values(ALERT_TYPES)}])[event_id % 6 + 1] AS alert_type, ticker || ': ' || "
        f"([{_values(ALERT_TYPES)}])[event_id % 6 + 1] AS message, ([{_values(ALERT_SIGNALS)}])[event_id % 6 + 1] AS signal, price AS "
        f"price_at_alert, k % 2 = 0 AS is_read, ts AS created_at FROM v_ticks WHERE event_type = 'error'"
    ),
    "v_feedback": (
        f"SELECT doc_id AS alert_id, user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS user_id, ([{_values(ALERT_TYPES)}])[doc_id "
        f"% 6 + 1] AS alert_type, quality = 1 AS is_positive FROM labels LEFT JOIN events ON event_id = doc_id"
    ),
    "v_signals": (
        "SELECT event_id AS id, user_id, ticker, (['BUY', 'SELL', 'HOLD'])[event_id % 3 + 1] AS signal, price AS price_at_signal, ts AS "
        "created_at FROM v_ticks WHERE event_type = 'click'"
    ),
    "v_live": "SELECT ticker, arg_max(price, (ts, event_id)) AS price FROM v_ticks GROUP BY ticker",
    "v_folded": (
        "SELECT user_id, ticker, list_reduce(list_prepend({'d': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE}, "
        "list({'d': CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END, 'p': fill_price, 'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE} ORDER BY "
        "ts, id)), lambda s, x: {'d': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': CASE WHEN s.q + x.d <= 0 THEN 0.0 ELSE s.q + x.d END, 'a': CASE "
        "WHEN s.q + x.d <= 0 THEN 0.0 WHEN x.d > 0 THEN (s.q * s.a + x.d * x.p) / (s.q + x.d) ELSE s.a END}) AS s FROM v_trades GROUP BY "
        "user_id, ticker"
    ),
    "v_positions": "SELECT user_id, ticker, s.q AS quantity, s.a AS avg_cost FROM v_folded",
    "v_open": "SELECT * FROM v_positions WHERE quantity > 0",
    "v_bars": (
        "SELECT ticker, ts, event_id, 1000000 + CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN price_c ELSE -price_c END) "
        "OVER (PARTITION BY ticker ORDER BY ts, event_id) AS BIGINT) AS close_c, price_c AS volume_c FROM v_ticks"
    ),
    "v_dedup": "SELECT seq, source, text, published FROM v_articles QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY seq) = 1",
    "v_clean": (
        r"SELECT seq, source, text, published, trim(regexp_replace(regexp_replace(regexp_replace(text, 'http[^ \t\n\r\f\x0B]+', '', 'g'), "
        r"'[^A-Za-z0-9 \t\n\r\f\x0B.,!?]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS clean FROM v_dedup"
    ),
    "v_scored": "SELECT seq, c / sqrt(c * c + 15.0) AS score FROM (SELECT seq, (" + " + ".join(
        f"{round(v * 100)} * len(list_filter(w, lambda x: x = '{t}'))"
        for t, v in LEXICON.items()
    ) + ") / 100.0::DOUBLE AS c FROM (SELECT seq, string_split(lower(clean), ' ') AS w FROM v_clean))",
    "v_keywords": "SELECT ticker, upper(split_part(ticker, '.', 1)) AS keyword FROM (SELECT unnest([" + _values(KEYWORDS) + "]) AS ticker)",
    "v_sentiment": (
        f"SELECT a.seq * 16 + list_position([{_values(KEYWORDS)}], k.ticker) AS id, k.ticker, coalesce(a.published, TIMESTAMP '2024-01-30 "
        f"00:00:00') AS ts, s.score, a.seq, a.source FROM v_clean a JOIN v_keywords k ON contains(upper(a.text), k.keyword) JOIN v_scored "
        f"s ON s.seq = a.seq"
    ),
}


def with_views(sql: str) -> str:
    """The statement with the views that it names, directly or through others, in front."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z]+\b", text):
            if name not in needed and name in VIEWS:
                visit(VIEWS[name])
                needed[name] = None

    visit(sql)
    head = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    if not head:
        return sql
    begin, rest = re.match(r"\s*(WITH RECURSIVE|WITH|)\s*(.*)", sql, re.DOTALL | re.IGNORECASE).groups()
    return f"{begin or 'WITH'} {head}{', ' if begin else ' '}{rest}"
