"""Queries on positions, valuation, history and trade execution."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import history as hist
from ledgerloom.operators import market, positions, trading
from ledgerloom.sources import tables as src

NOW = "2024-01-31 00:00:00"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return positions.average_cost(src.trades(spark, d))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return market.live_price(src.ticks(spark, d))


def _valued(spark: SparkSession, d: str) -> DataFrame:
    return positions.valued(_positions(spark, d), _live(spark, d))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return market.bars(src.ticks(spark, d), "1 hour").select("ticker", F.col("bar_ts").alias("ts"), "close")


def avg_cost_positions(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d)


def open_positions(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d).where("quantity > 0")


def holdings_valuation(spark: SparkSession, d: str) -> DataFrame:
    return _valued(spark, d)


def portfolio_value(spark: SparkSession, d: str) -> DataFrame:
    cents = F.floor(F.col("current_value") * 100 + 0.5)
    return _valued(spark, d).groupBy("user_id").agg((F.sum(cents) / 100.0).alias("total_value"))


def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    live = _live(spark, d).select("ticker", F.nullif("price", F.lit(0.0)).alias("price"))
    cents = lambda c: F.sum(F.floor(F.col(c) * 100 + 0.5))
    sums = positions.valued(_positions(spark, d), live).groupBy("user_id").agg(
        cents("invested").alias("i"),
        cents("current_value").alias("v"),
        F.count("*").alias("n_positions"),
    )
    pct = F.when(F.col("i") > 0, scalars.half_up((F.col("v") - F.col("i")) / F.when(F.col("i") > 0, F.col("i")) * 100)).otherwise(0.0)
    return sums.select(
        "user_id",
        (F.col("i") / 100.0).alias("invested"),
        (F.col("v") / 100.0).alias("value"),
        ((F.col("v") - F.col("i")) / 100.0).alias("gain"),
        pct.alias("gain_pct"),
        "n_positions",
    )


def holding_roi(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d).where("quantity > 0").join(_live(spark, d), "ticker")
    roi = scalars.ratio_percent(F.col("price") - F.col("avg_cost"), F.col("avg_cost"))
    return rows.select("user_id", "ticker", scalars.half_up(roi).alias("roi"))


def holding_lookup(spark: SparkSession, d: str) -> DataFrame:
    one = src.trades(spark, d).where((F.col("user_id") == 7) & (F.col("ticker") == "T3"))
    return positions.average_cost(one)


def holdings_by_user(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d).where("quantity > 0").groupBy("user_id")
    return rows.agg(F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("tickers"), F.count("*").alias("n"))


def concentration(spark: SparkSession, d: str) -> DataFrame:
    return trading.concentration(_valued(spark, d)).select("user_id", "ticker", scalars.half_up(F.col("share"), 6).alias("share"), "over_cap")


def sector_weight(spark: SparkSession, d: str) -> DataFrame:
    sector = F.concat(F.lit("S"), (F.substring("ticker", 2, 9).cast("int") % 4).cast("string"))
    cents = F.floor(F.col("current_value") * 100 + 0.5)
    sums = _valued(spark, d).groupBy("user_id", sector.alias("sector")).agg(F.sum(cents).alias("c"))
    total = F.sum("c").over(Window.partitionBy("user_id"))
    share = F.col("c") / F.when(total > 0, total)
    return sums.select("user_id", "sector", scalars.half_up(share, 6).alias("weight"), (share > 0.4).alias("overweight"))


def limits_update(spark: SparkSession, d: str) -> DataFrame:
    """A request sets what it names and can't clear: users divisible by 5 ask for a stop of 9 and no target."""
    asked = F.when(F.col("user_id") % 5 == 0, F.lit(9.0))
    return src.limits(spark, d).select(
        "user_id",
        "ticker",
        F.coalesce(asked, "sl_pct").alias("sl_pct"),
        F.coalesce(F.lit(None).cast("double"), "tg_pct").alias("tg_pct"),
    )


def delete_holding_status(spark: SparkSession, d: str) -> DataFrame:
    """404 for no holding, 400 for an open one, 200 for an empty one; asked for every user and the tickers T0 to T2."""
    asked = src.users(spark, d).select(F.col("id").alias("user_id")).crossJoin(spark.createDataFrame([("T0",), ("T1",), ("T2",)], "ticker string"))
    found = asked.join(_positions(spark, d), ["user_id", "ticker"], "left")
    status = F.when(F.col("quantity").isNull(), 404).when(F.col("quantity") > 0, 400).otherwise(200)
    return found.select("user_id", "ticker", status.alias("status"))


def user_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Users with odd ids exist; logging in as every customer adds the others with the default balance."""
    stored = src.users(spark, d).where("id % 2 = 1").select("id", "email", F.lit(5000.0).alias("virtual_balance"))
    asked = src.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@example.com")).alias("email"))
    new = asked.join(stored.select("email"), "email", "left_anti").select("id", "email", F.lit(src.START_BALANCE).alias("virtual_balance"))
    return stored.unionByName(new)


def fill_price(spark: SparkSession, d: str) -> DataFrame:
    fill = scalars.fill_price(F.col("side"), F.col("fill_price"))
    rows = src.trades(spark, d).select("id", "side", "quantity", fill.alias("fill"))
    amount = F.when(F.col("side") == "BUY", F.col("quantity") * F.col("fill")).otherwise(scalars.sale_proceeds(F.col("quantity"), F.col("fill")))
    return rows.select("id", "side", scalars.half_up(F.col("fill"), 4).alias("fill"), scalars.half_up(amount, 4).alias("amount"))


def trade_validation(spark: SparkSession, d: str) -> DataFrame:
    orders = src.trades(spark, d).select("id", "side", "quantity", F.col("fill_price").alias("price"))
    return trading.validated(orders, src.TRADING_BALANCE).select("id", "status")


def avg_cost_sliced(spark: SparkSession, d: str) -> DataFrame:
    """avg_cost_positions by the scan that composes, every pair in slices of a day; averages to six decimals."""
    rows = positions.last_states(positions.sliced_states(src.trades(spark, d)))
    return rows.select("user_id", "ticker", "quantity", scalars.half_up(F.col("avg_cost"), 6).alias("avg_cost"))


def execute_trades(spark: SparkSession, d: str) -> DataFrame:
    orders = src.trades(spark, d).withColumnRenamed("fill_price", "price")
    balances = src.users(spark, d).select(F.col("id").alias("user_id"), F.lit(src.TRADING_BALANCE).alias("balance"))
    return trading.execute_trades(orders, balances, src.ticks(spark, d).select("ticker", "ts", "event_id", "price"))


#: The design's gates on the traded tickers: T0 to T18 are listed, and their sectors are those of sector_weight.
GATES = replace(trading.DESIGN, tickers="T1?[0-8]|T9", sectors={f"T{n}": f"S{n % 4}" for n in range(20)})


def execute_gated(spark: SparkSession, d: str) -> DataFrame:
    """execute_trades with the design's gates: listed tickers, market hours, share of an order and of a sector."""
    orders = src.trades(spark, d).withColumnRenamed("fill_price", "price")
    balances = src.users(spark, d).select(F.col("id").alias("user_id"), F.lit(src.TRADING_BALANCE).alias("balance"))
    return trading.execute_trades(orders, balances, src.ticks(spark, d).select("ticker", "ts", "event_id", "price"), GATES)


def recent_trades(spark: SparkSession, d: str) -> DataFrame:
    return src.trades(spark, d).where("user_id = 7").orderBy(F.desc("ts"), F.desc("id")).limit(50)


def running_cash(spark: SparkSession, d: str) -> DataFrame:
    return hist.running_cash(src.trades(spark, d), src.START_BALANCE).select("id", "user_id", (F.col("cash_c") / 100.0).alias("cash"))


def cash_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each user's balance at each midnight after the first trade."""
    trades = src.trades(spark, d)
    days = trades.select("user_id").distinct().crossJoin(
        F.broadcast(
            spark.range(1, 31).select(
                F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("ts"),
            ),
        ),
    )
    joined = market.as_of(days, hist.running_cash(trades, src.START_BALANCE), ["user_id"], "ts", ["cash_c"], "id")
    return joined.where("asof_cash_c IS NOT NULL").select("user_id", "ts", (F.col("asof_cash_c") / 100.0).alias("cash"))


def history_grid(spark: SparkSession, d: str) -> DataFrame:
    return hist.grid(src.trades(spark, d), _hourly(spark, d), NOW)


def portfolio_history(spark: SparkSession, d: str) -> DataFrame:
    return hist.history(src.trades(spark, d), _hourly(spark, d), src.START_BALANCE, NOW)


def history_interval(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars if the first trade is over 7 full days ago, else quarters of an hour."""
    first = hist.first_trades(src.trades(spark, d))
    seconds = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    return first.select("user_id", F.when(F.floor(seconds / 86400) > 7, "1h").otherwise("15m").alias("interval"))


def time_label(spark: SparkSession, d: str) -> DataFrame:
    return src.trades(spark, d).select("id", F.date_format(scalars.local_time(F.col("ts")), "MMM dd HH:mm").alias("label"))


def label_hue(spark: SparkSession, d: str) -> DataFrame:
    """The colour of each user's line in a chart."""
    return src.users(spark, d).select("id", "name", scalars.hue(F.col("name")).alias("hue"))


QUERIES = {
    f.__name__: f
    for f in (
        avg_cost_positions,
        open_positions,
        holdings_valuation,
        portfolio_value,
        dashboard_summary,
        holding_roi,
        holding_lookup,
        holdings_by_user,
        concentration,
        sector_weight,
        limits_update,
        delete_holding_status,
        user_upsert,
        fill_price,
        trade_validation,
        avg_cost_sliced,
        execute_trades,
        execute_gated,
        recent_trades,
        running_cash,
        cash_asof,
        history_grid,
        portfolio_history,
        history_interval,
        time_label,
        label_hue,
    )
}

_VALUED = "SELECT p.user_id, p.ticker, quantity, avg_cost, coalesce(l.price, avg_cost) AS price, coalesce(l.price, avg_cost) * quantity AS current_value, avg_cost * quantity AS invested, coalesce(l.price, avg_cost) * quantity - avg_cost * quantity AS pnl, CASE WHEN avg_cost * quantity > 0 THEN (coalesce(l.price, avg_cost) * quantity - avg_cost * quantity) / (avg_cost * quantity) * 100 ELSE 0.0 END AS pnl_pct FROM v_open p LEFT JOIN v_live l ON l.ticker = p.ticker"
_CASH = "SELECT id, user_id, ts, 10000000 + sum(CASE WHEN side = 'BUY' THEN -1 ELSE 1 END * CAST(round(quantity * fill_price * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, id) AS cash_c FROM v_trades"
_HOURLY = "SELECT ticker, date_trunc('hour', ts) AS ts, arg_max(price, (ts, event_id)) AS close FROM v_ticks GROUP BY ALL"
_GRID = f"""found AS (SELECT DISTINCT p.user_id, h.ts FROM (SELECT DISTINCT user_id, ticker FROM v_trades) p JOIN (SELECT user_id, min(ts) AS start FROM v_trades GROUP BY user_id) f ON f.user_id = p.user_id JOIN hourly h ON h.ticker = p.ticker AND h.ts >= f.start),
grid AS (SELECT * FROM found UNION ALL SELECT DISTINCT user_id, TIMESTAMP '{NOW}' FROM v_trades WHERE user_id NOT IN (SELECT user_id FROM found))"""

_BUY, _SELL = (f"o.price * (1 {sign} {scalars.SLIPPAGE}::DOUBLE)" for sign in "+-")

#: Orders one by one by recursion: o holds each user's orders by number, q the prices of all tickers as of each, and s the
#: account after each order, with held quantities as a list by ticker number.
_REPLAY = f"""WITH RECURSIVE p AS (SELECT ticker, ts, arg_max(price, event_id) AS price FROM v_ticks WHERE price > 0 GROUP BY ALL),
n AS (SELECT id, user_id, ticker, CAST(substr(ticker, 2) AS INT) + 1 AS i, side, quantity, fill_price AS price, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM v_trades),
w AS (SELECT id, ts, i, j, 'T' || (j - 1) AS ticker FROM n, range(1, 21) g(j) WHERE side = 'BUY'),
q AS (SELECT w.id, list(p.price ORDER BY w.j) AS quotes FROM w ASOF LEFT JOIN p ON p.ticker = w.ticker AND w.ts >= p.ts GROUP BY w.id),
o AS MATERIALIZED (SELECT n.*, list_transform(quotes, lambda x, k: CASE WHEN k = i THEN price ELSE x END) AS quotes FROM n LEFT JOIN q USING (id)),
s AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS status,
        {src.TRADING_BALANCE}::DOUBLE AS balance, list_transform(range(20), lambda x: 0.0::DOUBLE) AS held FROM o
    UNION ALL
    SELECT user_id, n, id, status,
        CASE WHEN status <> 'OK' THEN balance WHEN side = 'BUY' THEN balance - buy * quantity
            ELSE balance + sell * quantity * (1 - {scalars.SELL_TAX}::DOUBLE) END,
        CASE WHEN status <> 'OK' THEN held
            ELSE list_transform(held, lambda x, k: CASE WHEN k <> i THEN x WHEN side = 'BUY' THEN x + quantity ELSE x - quantity END) END
    FROM (SELECT *, CASE
            WHEN NOT quantity > 0 THEN 'BAD_QUANTITY'
            WHEN price IS NULL OR NOT price > 0 THEN 'NO_PRICE'
            WHEN side = 'SELL' AND held[i] < quantity THEN 'OVERSELL'
            WHEN side = 'SELL' THEN 'OK'
            WHEN balance < buy * quantity THEN 'BALANCE'
            WHEN len(list_filter(held, lambda x, k: x > 0 AND quotes[k] IS NULL)) > 0 THEN 'NO_PRICE'
            WHEN (held[i] * price + buy * quantity) / (list_sum(list_transform(held, lambda x, k: CASE WHEN x > 0 THEN x * quotes[k] ELSE 0 END)) + balance)
                > {scalars.STOCK_CAP}::DOUBLE THEN 'STOCK_CAP'
            ELSE 'OK' END AS status
        FROM (SELECT s.balance, s.held, o.*, {_BUY} AS buy, {_SELL} AS sell FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
),
done AS (SELECT o.id, o.user_id, o.ticker, o.side, o.quantity, o.ts, s.status, s.balance,
    CASE WHEN s.status = 'OK' THEN CASE WHEN o.side = 'BUY' THEN {_BUY} ELSE {_SELL} END END AS fill_price,
    CASE WHEN s.status = 'OK' THEN {scalars.SLIPPAGE}::DOUBLE END AS slippage FROM o JOIN s ON s.id = o.id) """
_LOCAL = "(ts + INTERVAL 330 MINUTES)"  # the zone has no summer time
_MINUTE = f"(hour({_LOCAL}) * 3600 + minute({_LOCAL}) * 60 + floor(second({_LOCAL})))"
_TOTAL = "(list_sum(list_transform(held, lambda x, k: CASE WHEN x > 0 THEN x * quotes[k] ELSE 0 END)) + balance)"
_GATED = (
    _REPLAY.replace(
        "WHEN NOT quantity > 0",
        f"WHEN NOT regexp_full_match(ticker, '{GATES.tickers}') THEN 'BAD_TICKER' WHEN isodow({_LOCAL}) > 5 OR NOT {_MINUTE} BETWEEN "
        f"{GATES.hours[0] * 60} AND {GATES.hours[1] * 60} THEN 'CLOSED' WHEN NOT quantity > 0",
    )
    .replace("WHEN (held[i] * price", f"WHEN buy * quantity / {_TOTAL} > {GATES.order_share}::DOUBLE THEN 'ORDER_CAP' WHEN (held[i] * price")
    .replace(
        "THEN 'STOCK_CAP'",
        f"THEN 'STOCK_CAP' WHEN (list_sum(list_transform(held, lambda x, k: CASE WHEN x > 0 AND k % 4 = i % 4 THEN x * CASE WHEN k = i THEN price ELSE "
        f"quotes[k] END ELSE 0 END)) + buy * quantity) / {_TOTAL} > {GATES.sector_share}::DOUBLE THEN 'SECTOR_CAP'",
    )
)
#: Every user of the orders has an account.
REPLAYED = _REPLAY + "SELECT id, user_id, ticker, side, quantity, fill_price, slippage, ts, balance AS virtual_balance_after, status FROM done"

SQL = {
    "avg_cost_positions": "SELECT user_id, ticker, quantity, avg_cost FROM v_positions",
    "avg_cost_sliced": "SELECT user_id, ticker, quantity, floor(avg_cost * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS avg_cost FROM v_positions",
    "open_positions": "SELECT user_id, ticker, quantity, avg_cost FROM v_open",
    "holdings_valuation": _VALUED,
    "portfolio_value": (
        f"SELECT user_id, CAST(sum(CAST(floor(current_value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS total_value FROM ({_VALUED}) "
        f"GROUP BY user_id"
    ),
    "dashboard_summary": (
        f"WITH s AS (SELECT user_id, CAST(sum(CAST(floor(invested * 100 + 0.5) AS BIGINT)) AS BIGINT) AS i, "
        f"CAST(sum(CAST(floor(current_value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS v, count(*) AS n_positions FROM "
        f"({_VALUED.replace('v_live l', '(SELECT ticker, nullif(price, 0.0) AS price FROM v_live) l')}) GROUP BY user_id) SELECT user_id, "
        f"i / 100.0::DOUBLE AS invested, v / 100.0::DOUBLE AS value, (v - i) / 100.0::DOUBLE AS gain, CASE WHEN i > 0 THEN floor((v - i) / "
        f"i::DOUBLE * 100 * 100.0 + 0.5) / 100.0::DOUBLE ELSE 0.0 END AS gain_pct, n_positions FROM s"
    ),
    "holding_roi": (
        "SELECT p.user_id, p.ticker, floor((CASE WHEN avg_cost > 0 THEN (l.price - avg_cost) / avg_cost * 100 ELSE 0.0 END) * "
        "100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS roi FROM v_open p JOIN v_live l ON l.ticker = p.ticker"
    ),
    "holding_lookup": "SELECT user_id, ticker, quantity, avg_cost FROM v_positions WHERE user_id = 7 AND ticker = 'T3'",
    "holdings_by_user": "SELECT user_id, string_agg(ticker, ',' ORDER BY ticker) AS tickers, count(*) AS n FROM v_open GROUP BY user_id",
    "concentration": (
        f"WITH c AS (SELECT user_id, ticker, CAST(floor(current_value * 100 + 0.5) AS BIGINT) AS c FROM ({_VALUED})), t AS (SELECT *, "
        f"CAST(sum(c) OVER (PARTITION BY user_id) AS BIGINT) AS t FROM c) SELECT user_id, ticker, floor(c / t::DOUBLE * 1000000.0::DOUBLE "
        f"+ 0.5) / 1000000.0::DOUBLE AS share, c / t::DOUBLE > 0.3 AS over_cap FROM t"
    ),
    "sector_weight": (
        f"WITH c AS (SELECT user_id, 'S' || (CAST(substr(ticker, 2) AS INT) % 4) AS sector, CAST(sum(CAST(floor(current_value * 100 + 0.5) "
        f"AS BIGINT)) AS BIGINT) AS c FROM ({_VALUED}) GROUP BY ALL), t AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id) AS BIGINT) "
        f"AS t FROM c) SELECT user_id, sector, floor(c / t::DOUBLE * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS weight, c / t::DOUBLE "
        f"> 0.4 AS overweight FROM t"
    ),
    "limits_update": "SELECT user_id, ticker, CASE WHEN user_id % 5 = 0 THEN 9.0::DOUBLE ELSE sl_pct END AS sl_pct, tg_pct FROM v_limits",
    "delete_holding_status": (
        "SELECT u.id AS user_id, t.ticker, CASE WHEN p.quantity IS NULL THEN 404 WHEN p.quantity > 0 THEN 400 ELSE 200 END AS status FROM "
        "v_users u CROSS JOIN (VALUES ('T0'), ('T1'), ('T2')) t(ticker) LEFT JOIN v_positions p ON p.user_id = u.id AND p.ticker = t.ticker"
    ),
    "user_upsert": (
        "WITH s AS (SELECT id, email, 5000.0::DOUBLE AS virtual_balance FROM v_users WHERE id % 2 = 1) SELECT * FROM s UNION ALL SELECT "
        "c_custkey, c_name || '@example.com', 100000.0::DOUBLE FROM customer WHERE c_name || '@example.com' NOT IN (SELECT email FROM s)"
    ),
    "fill_price": (
        "WITH f AS (SELECT id, side, quantity, CASE WHEN side = 'BUY' THEN fill_price * (1 + 0.0005::DOUBLE) ELSE fill_price * (1 - "
        "0.0005::DOUBLE) END AS fill FROM v_trades) SELECT id, side, floor(fill * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS fill, "
        "floor((CASE WHEN side = 'BUY' THEN quantity * fill ELSE quantity * fill * (1 - 0.001::DOUBLE) END) * 10000.0::DOUBLE + 0.5) / "
        "10000.0::DOUBLE AS amount FROM f"
    ),
    "trade_validation": (
        "SELECT id, CASE WHEN NOT quantity > 0 THEN 'BAD_QUANTITY' WHEN fill_price IS NULL OR NOT fill_price > 0 THEN 'NO_PRICE' WHEN side "
        "= 'BUY' AND 4000.0::DOUBLE < quantity * fill_price * (1 + 0.0005::DOUBLE) THEN 'BALANCE' WHEN side = 'BUY' AND quantity * "
        "fill_price * (1 + 0.0005::DOUBLE) / 4000.0::DOUBLE > 0.3 THEN 'STOCK_CAP' ELSE 'OK' END AS status FROM v_trades"
    ),
    "execute_trades": _REPLAY + """SELECT d.id, user_id, ticker, side, quantity, CASE WHEN u.id IS NOT NULL THEN fill_price END AS fill_price,
    CASE WHEN u.id IS NOT NULL THEN slippage END AS slippage, ts, CASE WHEN u.id IS NOT NULL THEN balance END AS virtual_balance_after,
    CASE WHEN u.id IS NOT NULL THEN status ELSE 'NO_USER' END AS status FROM done d LEFT JOIN v_users u ON u.id = d.user_id""",
    "execute_gated": _GATED + """SELECT d.id, user_id, ticker, side, quantity, CASE WHEN u.id IS NOT NULL THEN fill_price END AS fill_price,
    CASE WHEN u.id IS NOT NULL THEN slippage END AS slippage, ts, CASE WHEN u.id IS NOT NULL THEN balance END AS virtual_balance_after,
    CASE WHEN u.id IS NOT NULL THEN status ELSE 'NO_USER' END AS status FROM done d LEFT JOIN v_users u ON u.id = d.user_id""",
    "recent_trades": "SELECT id, user_id, ticker, side, quantity, fill_price, ts FROM v_trades WHERE user_id = 7 ORDER BY ts DESC, id DESC LIMIT 50",
    "running_cash": f"SELECT id, user_id, CAST(cash_c AS DOUBLE) / 100.0 AS cash FROM ({_CASH})",
    "cash_asof": (
        f"WITH c AS ({_CASH}), days AS (SELECT user_id, ts FROM (SELECT DISTINCT user_id FROM v_trades), (SELECT CAST(DATE '2024-01-01' + "
        f"CAST(i AS INT) AS TIMESTAMP) AS ts FROM range(1, 31) t(i))) SELECT d.user_id, d.ts, CAST(arg_max(cash_c, (c.ts, c.id)) AS "
        f"DOUBLE) / 100.0 AS cash FROM days d JOIN c ON c.user_id = d.user_id AND c.ts <= d.ts GROUP BY ALL"
    ),
    "history_grid": f"WITH hourly AS ({_HOURLY}), {_GRID} SELECT user_id, ts FROM grid",
    "portfolio_history": f"""WITH hourly AS ({_HOURLY}), {_GRID},
numbered AS (SELECT user_id, ticker, id, ts, fill_price AS p, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS d, row_number() OVER (PARTITION BY user_id, ticker ORDER BY ts, id) AS n FROM v_trades),
folded AS (SELECT user_id, ticker, list({{'d': d, 'p': p, 'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE}} ORDER BY n) AS l FROM numbered GROUP BY ALL),
states AS (SELECT x.user_id, x.ticker, x.id, x.ts, list_reduce(list_prepend({{'d': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE}}, l[1:x.n]), lambda s, y: {{'d': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': CASE WHEN s.q + y.d <= 0 THEN 0.0 ELSE s.q + y.d END, 'a': CASE WHEN s.q + y.d <= 0 THEN 0.0 WHEN y.d > 0 THEN (s.q * s.a + y.d * y.p) / (s.q + y.d) ELSE s.a END}}) AS s FROM numbered x JOIN folded f ON f.user_id = x.user_id AND f.ticker = x.ticker),
last_states AS (SELECT user_id, ticker, ts, arg_max(s, id) AS s FROM states GROUP BY ALL),
wanted AS (SELECT p.user_id, p.ticker, g.ts FROM (SELECT DISTINCT user_id, ticker FROM v_trades) p JOIN grid g ON g.user_id = p.user_id),
held AS (SELECT w.user_id, w.ticker, w.ts, s.s.q AS q, s.s.a AS a FROM wanted w ASOF JOIN last_states s ON s.user_id = w.user_id AND s.ticker = w.ticker AND w.ts >= s.ts),
priced AS (SELECT h.user_id, h.ts, CAST(floor(h.q * coalesce(b.close, h.a) * 100 + 0.5) AS BIGINT) AS c FROM (SELECT * FROM held WHERE q > 0) h ASOF LEFT JOIN hourly b ON b.ticker = h.ticker AND h.ts >= b.ts),
stock AS (SELECT user_id, ts, count(*) AS n_open, CAST(sum(c) AS BIGINT) AS stock_c FROM priced GROUP BY ALL),
cash AS (SELECT user_id, ts, arg_max(cash_c, id) AS cash_c FROM ({_CASH}) GROUP BY ALL),
total AS (SELECT g.user_id, g.ts, coalesce(s.n_open, 0) AS n_open, CAST(c.cash_c + coalesce(s.stock_c, 0) AS DOUBLE) / 100.0 AS total_value FROM grid g ASOF JOIN cash c ON c.user_id = g.user_id AND g.ts >= c.ts LEFT JOIN stock s ON s.user_id = g.user_id AND s.ts = g.ts)
SELECT user_id, ts, n_open, total_value FROM (SELECT *, max(CASE WHEN n_open = 0 THEN ts END) OVER (PARTITION BY user_id) AS flat FROM total) WHERE flat IS NULL OR ts > flat""",
    "history_interval": (
        f"SELECT user_id, CASE WHEN floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(min(ts)))) / 86400) > 7 THEN '1h' ELSE '15m' END AS "
        f"interval FROM v_trades GROUP BY user_id"
    ),
    "time_label": "SELECT id, strftime(ts + INTERVAL 330 MINUTES, '%b %d %H:%M') AS label FROM v_trades",
    "label_hue": """SELECT id, name, abs(list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(ascii(c) AS BIGINT) for c in string_split(name, '')]),
    lambda h, c: c + xor((h * 32) & 4294967295, 2147483648) - 2147483648 - h) % 360) AS hue FROM v_users""",
}
