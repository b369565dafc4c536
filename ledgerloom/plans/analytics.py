"""Second-wave queries: ranges, risk, signal quality, retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import advice, analytics, market, positions
from ledgerloom.plans import portfolio
from ledgerloom.plans.monitor import SQL as MONITOR_SQL
from ledgerloom.plans.monitor import quiet_portfolios, sentiment_scores
from ledgerloom.sources import tables as src


def high_low_52w(spark: SparkSession, d: str) -> DataFrame:
    series = src.read(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("key"),
        F.col("o_orderdate").alias("d"),
    ).agg(F.max("o_totalprice").alias("value"))
    return analytics.range_extremes(series)


def rolling_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """Mean over deviation of the last 10 daily returns, in integer parts per million so that sums are exact."""
    rows = analytics.daily_returns(market.bars(src.ticks(spark, d), "1 day")).select("ticker", "bar_ts", F.floor(F.col("ret") * 1e6 + 0.5).alias("r"))
    by = Window.partitionBy("ticker").orderBy("bar_ts").rowsBetween(-9, 0)
    sums = rows.select("ticker", "bar_ts", F.count("*").over(by).alias("n"), F.sum("r").over(by).alias("s"), F.sum(F.col("r") * F.col("r")).over(by).alias("q"))
    spread = F.col("q") * 10 - F.col("s") * F.col("s")
    sharpe = (F.col("s") / 10.0) / F.sqrt(F.when(spread > 0, spread) / 90.0)
    return sums.where("n = 10").select("ticker", "bar_ts", scalars.half_up(sharpe, 6).alias("sharpe"))


def var_daily(spark: SparkSession, d: str) -> DataFrame:
    """The empirical 5th percentile (nearest rank) of daily returns, and whether its loss is within 15 %."""
    rows = analytics.daily_returns(market.bars(src.ticks(spark, d), "1 day"))
    by = Window.partitionBy("ticker").orderBy("ret", "bar_ts")
    ranked = rows.select("ticker", "ret", F.row_number().over(by).alias("n"), F.count("*").over(Window.partitionBy("ticker")).alias("all"))
    return ranked.where(F.col("n") == F.ceil(F.col("all") * 0.05)).select(
        "ticker",
        scalars.half_up(F.col("ret"), 9).alias("var_5"),
        (F.col("ret") >= -0.15).alias("within"),
    )


def sentiment_decayed(spark: SparkSession, d: str) -> DataFrame:
    rows = sentiment_scores(spark, d)
    weight = src.pick(analytics.CREDIBILITY, F.pmod(F.substring("source", 4, 9).cast("int"), F.lit(3)))
    return analytics.decayed_sentiment(rows.select("ticker", "ts", "score", weight.alias("credibility")), rows.agg(F.max("ts").alias("now")))


def sentiment_delta_2h(spark: SparkSession, d: str) -> DataFrame:
    """The latest score in each ticker's two hours before, and whether it fell or rose by more than 0.4."""
    rows = analytics.recent_change(sentiment_scores(spark, d))
    return rows.select("id", (F.col("fell") < -0.4).alias("crash"), (F.col("rose") > 0.4).alias("surge"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each signal with the ticker's price a week later: the last at or before; null while the data end earlier."""
    ticks = src.ticks(spark, d)
    rows = src.signals(spark, d).withColumn("ts", F.col("created_at") + F.expr("INTERVAL 7 DAYS"))
    end = ticks.agg(F.max("ts").alias("end"))
    joined = market.as_of(
        rows,
        ticks.select("ticker", "ts", "price", "event_id"),
        ["ticker"],
        "ts",
        ["price"],
        "event_id",
        bucket="1 day",
    ).crossJoin(F.broadcast(end))
    after = F.when(F.col("ts") <= F.col("end"), F.col("asof_price"))
    return joined.select(
        "id",
        "ticker",
        "signal",
        "price_at_signal",
        after.alias("after"),
        analytics.outcome(F.col("signal"), F.col("price_at_signal"), after).alias("outcome"),
    )


def signal_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("id", "signal", "outcome", F.col("after").alias("outcome_price"))


def signal_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """By signal: share of right ones in percent, and the loss that right sales avoided for each share, in cents."""
    right = F.col("outcome") == "CORRECT"
    avoided = F.when(right & (F.col("signal") == "SELL"), src.cents(F.col("price_at_signal")) - src.cents(F.col("after"))).otherwise(0)
    sums = _outcomes(spark, d).where("outcome IS NOT NULL").groupBy("signal").agg(
        F.count("*").alias("n"),
        F.sum(F.when(right, 1).otherwise(0)).alias("ok"),
        F.sum(avoided).alias("avoided_c"),
    )
    return sums.select("signal", "n", scalars.half_up(F.col("ok") / F.col("n") * 100).alias("accuracy"), "avoided_c")


def alert_engagement(spark: SparkSession, d: str) -> DataFrame:
    """By type of alert: which were answered by a trade within a day, which answers led to a loss a week later, and ratings."""
    alerts, ticks = src.alert_log(spark, d), src.ticks(spark, d)
    answered = advice.answers(alerts, src.trades(spark, d))
    return advice.engagement(alerts, advice.lost(answered, ticks), src.ratings(spark, d))


def advice_equity(spark: SparkSession, d: str) -> DataFrame:
    """The daily return, equity (as its logarithm, which is as exact for large values) and rolling Sharpe ratio of following all signals."""
    returns = analytics.daily_returns(market.bars(src.ticks(spark, d), "1 day"))
    return advice.equity_curve(advice.followed(src.signals(spark, d), returns)).drop("equity")


def portfolio_var(spark: SparkSession, d: str) -> DataFrame:
    """Value at risk of each user's holdings by historical simulation."""
    returns = analytics.daily_returns(market.bars(src.ticks(spark, d), "1 day"))
    return advice.portfolio_var(portfolio.holdings_valuation(spark, d), returns)


def eod_digest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's holdings at the last close of the data against the close a day before, in cents."""
    daily = market.bars(src.ticks(spark, d), "1 day")
    last = market.latest_k(daily, "ticker", 2, "bar_ts").groupBy("ticker").agg(
        F.max(F.when(F.col("n") == 1, F.col("close"))).alias("now"),
        F.max(F.when(F.col("n") == 2, F.col("close"))).alias("before"),
    )
    held = positions.average_cost(src.trades(spark, d)).where("quantity > 0").join(last, "ticker")
    day = F.floor(F.col("quantity") * (F.col("now") - F.col("before")) * 100 + 0.5)
    return held.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.sum(day).alias("day_pnl_c"),
        F.sum(F.floor(F.col("quantity") * F.col("now") * 100 + 0.5)).alias("value_c"),
    )


def eod_digest_holdings(spark: SparkSession, d: str) -> DataFrame:
    """The digest's rows: each holding's profit of the day in cents, the latest score of the news ticker that its ticker follows, and how many
    signals of each kind its ticker had in the day."""
    daily = market.bars(src.ticks(spark, d), "1 day")
    last = market.latest_k(daily, "ticker", 2, "bar_ts").groupBy("ticker").agg(
        F.max(F.when(F.col("n") == 1, F.col("bar_ts"))).alias("day"),
        F.max(F.when(F.col("n") == 1, F.col("close"))).alias("now"),
        F.max(F.when(F.col("n") == 2, F.col("close"))).alias("before"),
    )
    scores = market.latest_k(sentiment_scores(spark, d), "ticker", 1, "ts", "id").select(F.col("ticker").alias("news"), scalars.half_up(F.col("score"), 6).alias("score"))
    marks = src.signals(spark, d).withColumn("day", F.date_trunc("day", "created_at").cast("timestamp_ntz"))
    kinds = [F.count(F.when(F.col("signal") == s, 1)).alias(f"n_{s.lower()}") for s in ("BUY", "SELL", "HOLD")]
    tickers = last.withColumn("news", src.pick(src.KEYWORDS, F.substring("ticker", 2, 9).cast("int") % 6)).join(scores, "news", "left")
    tickers = tickers.join(marks.groupBy("ticker", "day").agg(*kinds), ["ticker", "day"], "left")
    held = positions.average_cost(src.trades(spark, d)).where("quantity > 0").join(tickers, "ticker")
    return held.select(
        "user_id",
        "ticker",
        F.floor(F.col("quantity") * (F.col("now") - F.col("before")) * 100 + 0.5).alias("day_pnl_c"),
        "score",
        *[F.coalesce(F.col(f"n_{s}"), F.lit(0)).alias(f"n_{s}") for s in ("buy", "sell", "hold")],
    )


def rag_top5(spark: SparkSession, d: str) -> DataFrame:
    rows = src.read(spark, d, "embeddings")
    query = rows.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return analytics.top_cosine(rows.where("vec_id <> 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), query, 5)


def rag_top5_own(spark: SparkSession, d: str) -> DataFrame:
    """The scope of one owner: the five most similar of the rows that carry the query's label."""
    rows = src.read(spark, d, "embeddings")
    query = rows.where("vec_id = 3").select(F.col("embedding").alias("q"), F.col("label").alias("owner"))
    own = rows.where("vec_id <> 3").join(F.broadcast(query.select("owner")), F.col("label") == F.col("owner"), "left_semi")
    return analytics.top_cosine(own.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), query.select("q"), 5)


# Alerts beyond the monitor's checks, and their priorities.
MORE_ALERTS = {
    "SENTIMENT_SURGE": "MEDIUM",
    "CONCENTRATION_RISK": "LOW",
    "SECTOR_OVERWEIGHT": "LOW",
    "HIGH_52W": "INFO",
    "LOW_52W": "INFO",
    "PORTFOLIO_FLAT": "INFO",
}


def more_alerts(spark: SparkSession, d: str) -> DataFrame:
    """alert_type, user_id (null: all), subject, priority: a score up by over 0.4 in two hours, a stock over 30 % or a sector over
    40 % of a user's holdings, a series at its 52-week high or low on its last day, a user without alerts for a week."""
    made = lambda rows, kind, user, subject: rows.select(
        F.lit(kind).alias("alert_type"),
        user.cast("bigint").alias("user_id"),
        subject.alias("subject"),
        F.lit(MORE_ALERTS[kind]).alias("priority"),
    )
    all_users, user = F.lit(None), F.col("user_id")
    series = high_low_52w(spark, d)
    last = series.groupBy("key").agg(F.max_by(F.struct("value", "high_52w", "low_52w"), "d").alias("l")).select("key", "l.*")
    surges = sentiment_delta_2h(spark, d).where("surge").select("id")
    parts = [
        made(surges, "SENTIMENT_SURGE", all_users, F.col("id").cast("string")),
        made(portfolio.concentration(spark, d).where("over_cap"), "CONCENTRATION_RISK", user, F.col("ticker")),
        made(portfolio.sector_weight(spark, d).where("overweight"), "SECTOR_OVERWEIGHT", user, F.col("sector")),
        made(last.where("value = high_52w"), "HIGH_52W", all_users, F.col("key")),
        made(last.where("value = low_52w"), "LOW_52W", all_users, F.col("key")),
        made(quiet_portfolios(spark, d), "PORTFOLIO_FLAT", F.col("id"), F.lit(None).cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    f.__name__: f
    for f in (
        more_alerts,
        high_low_52w,
        rolling_sharpe,
        var_daily,
        sentiment_decayed,
        sentiment_delta_2h,
        signal_outcome,
        signal_accuracy,
        alert_engagement,
        advice_equity,
        portfolio_var,
        eod_digest,
        eod_digest_holdings,
        rag_top5,
        rag_top5_own,
    )
}

_DAILY = "SELECT ticker, time_bucket(INTERVAL '1 day', ts) AS bar_ts, arg_max(price, (ts, event_id)) AS close FROM v_ticks GROUP BY 1, 2"
_RETURNS = f"SELECT ticker, bar_ts, close / before - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY bar_ts) AS before FROM ({_DAILY})) WHERE before > 0"
_OUTCOMES = """WITH s AS (SELECT *, created_at + INTERVAL 7 DAYS AS ts FROM v_signals), p AS (SELECT ticker, ts, arg_max(price, event_id) AS price FROM v_ticks GROUP BY ALL),
j AS (SELECT s.id, s.signal, s.price_at_signal AS b, CASE WHEN s.ts <= (SELECT max(ts) FROM v_ticks) THEN p.price END AS a FROM s ASOF LEFT JOIN p ON p.ticker = s.ticker AND s.ts >= p.ts),
o AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN CASE signal WHEN 'BUY' THEN a > b WHEN 'SELL' THEN a < b ELSE abs(a - b) * 100 <= b * 2 END THEN 'CORRECT' ELSE 'WRONG' END AS outcome FROM j) """
_R = f"SELECT ticker, bar_ts, CAST(floor(ret * 1000000.0::DOUBLE + 0.5) AS BIGINT) AS r FROM ({_RETURNS})"
SQL = {
    "alert_engagement": """WITH m AS (SELECT t.id AS trade_id, t.side, t.fill_price, t.ticker, t.ts, a.id, a.created_at FROM v_trades t ASOF JOIN v_alerts a
  ON a.user_id = t.user_id AND a.ticker = t.ticker AND t.ts > a.created_at),
f AS (SELECT * FROM m WHERE ts <= created_at + INTERVAL 24 HOURS QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, trade_id) = 1),
p AS (SELECT ticker, ts, arg_max(price, event_id) AS price FROM v_ticks GROUP BY ALL),
l AS (SELECT f.id, f.side, f.fill_price, f.ticker, f.ts + INTERVAL 7 DAYS AS until FROM f),
r AS (SELECT l.id, CASE WHEN until <= (SELECT max(ts) FROM v_ticks) THEN CASE WHEN side = 'BUY' THEN p.price < fill_price ELSE p.price > fill_price END END AS loss
  FROM l ASOF LEFT JOIN p ON p.ticker = l.ticker AND l.until >= p.ts),
s AS (SELECT a.alert_type, count(*) AS n, count(r.id) AS answered, count(loss) AS known, CAST(sum(CASE WHEN loss THEN 1 ELSE 0 END) AS BIGINT) AS losses
  FROM v_alerts a LEFT JOIN r ON r.id = a.id GROUP BY 1),
q AS (SELECT alert_type, count(*) AS rated, CAST(sum(CASE WHEN is_positive THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM v_feedback GROUP BY 1)
SELECT s.alert_type, n, answered, floor(answered / n::DOUBLE * 100 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS engagement_pct, known, losses,
  CASE WHEN known > 0 THEN floor(losses / known::DOUBLE * 100 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS false_pct,
  coalesce(rated, 0) AS rated, coalesce(positive, 0) AS positive FROM s LEFT JOIN q ON q.alert_type = s.alert_type""",
    "advice_equity": f"""WITH g AS (SELECT ticker, created_at, arg_max(signal, id) AS signal FROM v_signals WHERE signal <> 'HOLD' GROUP BY ALL),
h AS (SELECT x.bar_ts, x.r, g.signal FROM ({_R}) x ASOF LEFT JOIN g ON g.ticker = x.ticker AND x.bar_ts > g.created_at),
d AS (SELECT bar_ts, CAST(sum(CASE WHEN signal = 'BUY' THEN 1 ELSE 0 END) AS BIGINT) AS n_held, CAST(sum(CASE WHEN signal = 'BUY' THEN r ELSE 0 END) AS BIGINT) AS t FROM h GROUP BY 1),
e AS (SELECT bar_ts, n_held, CASE WHEN n_held > 0 THEN CAST(floor(t / n_held::DOUBLE + 0.5) AS BIGINT) ELSE 0 END AS r FROM d)
SELECT bar_ts, n_held, r, floor(CASE WHEN min(r) OVER a > -1000000 THEN sum(CASE WHEN r > -1000000 THEN ln(1 + r / 1000000.0::DOUBLE) END) OVER a END * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS log_equity,
  CASE WHEN count(*) OVER w = 10 THEN floor((sum(r) OVER w / 10.0::DOUBLE) / sqrt(CASE WHEN sum(r * r) OVER w * 10 - sum(r) OVER w * sum(r) OVER w > 0
    THEN (sum(r * r) OVER w * 10 - sum(r) OVER w * sum(r) OVER w) END / 90.0::DOUBLE) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE END AS sharpe
FROM e WINDOW a AS (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING), w AS (ORDER BY bar_ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "portfolio_var": f"""WITH c AS (SELECT user_id, ticker, CAST(floor(current_value * 100 + 0.5) AS BIGINT) AS c FROM ({portfolio.SQL['holdings_valuation']})),
t AS (SELECT user_id, CAST(sum(c) AS BIGINT) AS t FROM c GROUP BY 1),
m AS (SELECT user_id, bar_ts, CAST(sum(c * r) AS BIGINT) AS m FROM c JOIN ({_R}) x ON x.ticker = c.ticker GROUP BY 1, 2),
k AS (SELECT user_id, m, row_number() OVER (PARTITION BY user_id ORDER BY m) AS i, count(*) OVER (PARTITION BY user_id) AS n_days FROM m)
SELECT k.user_id, n_days, floor(m / t::DOUBLE / 1000000.0::DOUBLE * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS var_5,
  floor(m / t::DOUBLE / 1000000.0::DOUBLE * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE >= -0.15 AS "within" FROM k JOIN t ON t.user_id = k.user_id
WHERE i = ceil(n_days * 0.05::DOUBLE)""",
    "high_low_52w": (
        "SELECT key, d, value, max(value) OVER w AS high_52w, min(value) OVER w AS low_52w FROM (SELECT o_orderpriority AS key, " "o_orderdate AS d, max(o_totalprice) AS value FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY key ORDER BY d RANGE BETWEEN " "INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)"
    ),
    "rolling_sharpe": (
        f"SELECT ticker, bar_ts, floor((s / 10.0::DOUBLE) / sqrt((CASE WHEN q * 10 - s * s > 0 THEN q * 10 - s * s END) / 90.0::DOUBLE) * " f"1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS sharpe FROM (SELECT ticker, bar_ts, count(*) OVER w AS n, CAST(sum(r) OVER w AS " f"BIGINT) AS s, CAST(sum(r * r) OVER w AS BIGINT) AS q FROM (SELECT ticker, bar_ts, CAST(floor(ret * 1000000.0::DOUBLE + 0.5) AS " f"BIGINT) AS r FROM ({_RETURNS})) WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) " f"WHERE n = 10"
    ),
    "var_daily": (
        f"SELECT ticker, floor(ret * 1000000000.0::DOUBLE + 0.5) / 1000000000.0::DOUBLE AS var_5, ret >= -0.15 AS within FROM (SELECT " f"ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY ret, bar_ts) AS n, count(*) OVER (PARTITION BY ticker) AS total " f"FROM ({_RETURNS})) WHERE n = ceil(total * 0.05::DOUBLE)"
    ),
    "sentiment_decayed": (
        "WITH w AS (SELECT ticker, score, pow(2.0::DOUBLE, -((epoch((SELECT max(ts) FROM v_sentiment)) - epoch(ts)) / 3600.0::DOUBLE) / 4) " "* ([1.0::DOUBLE, 0.7::DOUBLE, 0.4::DOUBLE])[CAST(substr(source, 4) AS INT) % 3 + 1] AS w FROM v_sentiment), s AS (SELECT ticker, " "count(*) AS n_articles, CAST(sum(CAST(floor(w * 1000000000.0::DOUBLE + 0.5) AS BIGINT)) AS BIGINT) AS w, CAST(sum(CAST(floor(w * " "score * 1000000000.0::DOUBLE + 0.5) AS BIGINT)) AS BIGINT) AS ws FROM w GROUP BY ticker) SELECT ticker, n_articles, CASE WHEN w > " "0 THEN CAST(floor(ws / w::DOUBLE * 1000000.0::DOUBLE + 0.5) AS BIGINT) END AS score_e6, n_articles < 5 AS low_confidence FROM s"
    ),
    "sentiment_delta_2h": (
        "SELECT id, score - max(score) OVER w < -0.4 AS crash, score - min(score) OVER w > 0.4 AS surge FROM v_sentiment WINDOW w AS " "(PARTITION BY ticker ORDER BY ts RANGE BETWEEN INTERVAL 2 HOURS PRECEDING AND CURRENT ROW)"
    ),
    "signal_outcome": _OUTCOMES + "SELECT id, signal, outcome, a AS outcome_price FROM o",
    "signal_accuracy": _OUTCOMES + "SELECT signal, count(*) AS n, floor(sum(CASE WHEN outcome = 'CORRECT' THEN 1 ELSE 0 END)::DOUBLE / count(*) * 100 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS accuracy, CAST(sum(CASE WHEN outcome = 'CORRECT' AND signal = 'SELL' THEN CAST(round(b * 100) AS BIGINT) - CAST(round(a * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS avoided_c FROM o WHERE outcome IS NOT NULL GROUP BY signal",
    "eod_digest": (
        f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS n FROM ({_DAILY})), l AS (SELECT ticker, " f"max(CASE WHEN n = 1 THEN close END) AS now_, max(CASE WHEN n = 2 THEN close END) AS before_ FROM k GROUP BY ticker) SELECT " f"user_id, count(*) AS n, CAST(sum(CAST(floor(quantity * (now_ - before_) * 100 + 0.5) AS BIGINT)) AS BIGINT) AS day_pnl_c, " f"CAST(sum(CAST(floor(quantity * now_ * 100 + 0.5) AS BIGINT)) AS BIGINT) AS value_c FROM v_open JOIN l USING (ticker) GROUP BY " f"user_id"
    ),
    "eod_digest_holdings": f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS n FROM ({_DAILY})),
l AS (SELECT ticker, max(CASE WHEN n = 1 THEN bar_ts END) AS day_, max(CASE WHEN n = 1 THEN close END) AS now_, max(CASE WHEN n = 2 THEN close END) AS before_ FROM k GROUP BY ticker),
s AS (SELECT ticker, floor(score * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS score FROM v_sentiment QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, id DESC) = 1),
g AS (SELECT ticker, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day_, count(*) FILTER (signal = 'BUY') AS b, count(*) FILTER (signal = 'SELL') AS c, count(*) FILTER (signal = 'HOLD') AS h FROM v_signals GROUP BY ALL)
SELECT user_id, o.ticker, CAST(floor(quantity * (now_ - before_) * 100 + 0.5) AS BIGINT) AS day_pnl_c, s.score, coalesce(b, 0) AS n_buy, coalesce(c, 0) AS n_sell, coalesce(h, 0) AS n_hold
FROM v_open o JOIN l ON l.ticker = o.ticker LEFT JOIN s ON s.ticker = (['ITC.NS', 'LT.NS', 'ERING.NS', 'ONING.NS', 'THING.NS', '^NSEI'])[CAST(substr(o.ticker, 2) AS INT) % 6 + 1]
LEFT JOIN g ON g.ticker = o.ticker AND g.day_ = l.day_""",
    "rag_top5": (
        "WITH q AS (SELECT [CAST(x AS DOUBLE) for x in embedding] AS q FROM embeddings WHERE vec_id = 3), r AS (SELECT vec_id AS id, " "[CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings WHERE vec_id <> 3) SELECT id, floor(list_inner_product(v, q) / " "(sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS cosine FROM " "r, q ORDER BY cosine DESC, id LIMIT 5"
    ),
}

SQL["rag_top5_own"] = SQL["rag_top5"].replace("WHERE vec_id <> 3", "WHERE vec_id <> 3 AND label = (SELECT label FROM embeddings WHERE vec_id = 3)")

_LAST = f"(SELECT key, arg_max(value, d) AS value, arg_max(high_52w, d) AS high_52w, arg_max(low_52w, d) AS low_52w FROM ({SQL['high_low_52w']}) GROUP BY key)"
SQL["more_alerts"] = " UNION ALL ".join(
    f"SELECT '{kind}' AS alert_type, CAST({user} AS BIGINT) AS user_id, CAST({subject} AS VARCHAR) AS subject, '{MORE_ALERTS[kind]}' AS priority FROM {rows}"
    for kind, user, subject, rows in (
        ("SENTIMENT_SURGE", "NULL", "id", f"({SQL['sentiment_delta_2h']}) WHERE surge"),
        ("CONCENTRATION_RISK", "user_id", "ticker", f"({portfolio.SQL['concentration']}) WHERE over_cap"),
        ("SECTOR_OVERWEIGHT", "user_id", "sector", f"({portfolio.SQL['sector_weight']}) WHERE overweight"),
        ("HIGH_52W", "NULL", "key", f"{_LAST} WHERE value = high_52w"),
        ("LOW_52W", "NULL", "key", f"{_LAST} WHERE value = low_52w"),
        ("PORTFOLIO_FLAT", "id", "NULL", f"({MONITOR_SQL['quiet_portfolios']})"),
    )
)
