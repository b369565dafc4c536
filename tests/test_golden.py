"""Hand-made edge cases and sequential statements of the ordered operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import analytics, history, market, monitor, news, positions, trading
from ledgerloom.plans import streams as stream_plans
from ledgerloom.plans.portfolio import execute_trades
from ledgerloom.sources import schemas, tables
from ledgerloom.streaming import streams

T0 = dt.datetime(2024, 1, 1)
TRADES = "id long, user_id long, ticker string, side string, quantity double, fill_price double, ts timestamp_ntz"


def minutes(n: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=n)


def random_trades(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [
        (
            i,
            r.randrange(6),
            f"T{r.randrange(4)}",
            r.choice(("BUY", "BUY", "SELL")),
            float(r.randrange(1, 6)),
            r.randrange(100, 9999) / 100,
            minutes(r.randrange(300)),
        )
        for i in range(n)
    ]


def folded(trades: list[tuple]) -> dict:
    """(user, ticker) -> [(ts, id, quantity, average)] by plain loops."""
    out: dict = {}
    for i, u, k, side, n, p, ts in sorted(trades, key=lambda t: (t[6], t[0])):
        q, a = out.setdefault((u, k), [(None, None, 0.0, 0.0)])[-1][2:]
        if side == "BUY":
            q, a = q + n, (q * a + n * p) / (q + n)
        else:
            q -= n
            if q <= 0:
                q, a = 0.0, 0.0
        out[u, k].append((ts, i, q, a))
    return out


def test_average_cost_and_states(spark):
    trades = random_trades(400, 1)
    df = spark.createDataFrame(trades, TRADES)
    want = folded(trades)
    assert {(r.user_id, r.ticker): (r.quantity, r.avg_cost) for r in positions.average_cost(df).collect()} == {k: v[-1][2:] for k, v in want.items()}
    assert sorted((r.id, r.qty, r.avg) for r in positions.position_states(df).collect()) == sorted((i, q, a) for v in want.values() for _, i, q, a in v[1:])


def test_history_is_the_sequential_replay(spark):
    trades = random_trades(60, 2)
    r = random.Random(3)
    prices = {(f"T{k}", minutes(m)): r.randrange(100, 9999) / 100 for k in range(4) for m in r.sample(range(0, 400), 25)}
    got = history.history(
        spark.createDataFrame(trades, TRADES),
        spark.createDataFrame([(k, ts, p) for (k, ts), p in prices.items()], "ticker string, ts timestamp_ntz, close double"),
        100000.0,
        "2024-02-01 00:00:00",
    )
    want = []
    for u in {t[1] for t in trades}:
        own = sorted((t for t in trades if t[1] == u), key=lambda t: (t[6], t[0]))
        tickers = {t[2] for t in own}
        grid = sorted({ts for (k, ts) in prices if k in tickers and ts >= own[0][6]}) or [dt.datetime(2024, 2, 1)]
        kept = []
        for g in grid:
            past = [t for t in own if t[6] <= g]
            cash = 10000000 + sum((-1 if t[3] == "BUY" else 1) * round(t[4] * t[5] * 100) for t in past)
            held = {k: v[-1][2:] for k, v in folded(past).items() if v[-1][2] > 0}
            if not held:
                kept = []
                continue
            for (_, k), (q, a) in held.items():
                seen = [ts for (kk, ts) in prices if kk == k and ts <= g]
                cash += int(q * (prices[k, max(seen)] if seen else a) * 100 + 0.5)
            kept.append((u, g, len(held), cash / 100))
        want += kept
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_history_without_prices_uses_the_given_instant(spark):
    trades = spark.createDataFrame([(1, 1, "A", "BUY", 2.0, 10.0, T0)], TRADES)
    none = spark.createDataFrame([], "ticker string, ts timestamp_ntz, close double")
    assert [tuple(r) for r in history.history(trades, none, 100.0, "2024-02-01 00:00:00").collect()] == [(1, dt.datetime(2024, 2, 1), 1, 100.0)]


ORDERS = "id long, user_id long, ticker string, side string, quantity double, price double, ts timestamp_ntz"


def run_orders(spark, orders, balance=1000.0):
    rows = [(i, 1, *o, minutes(i)) for i, o in enumerate(orders)]
    users = spark.createDataFrame([(1, balance)], "user_id long, balance double")
    return sorted(trading.execute_trades(spark.createDataFrame(rows, ORDERS), users).collect())


def test_trade_rules_in_order(spark):
    got = run_orders(
        spark,
        [
            ("A", "HOLD", 1.0, 1.0),
            ("A", "BUY", 0.0, 1.0),
            ("A", "BUY", 1.0, None),
            ("A", "BUY", 10.0, 200.0),
            ("A", "BUY", 1.0, 400.0),
            ("A", "SELL", 1.0, 10.0),
            ("A", "BUY", 2.0, 100.0),
            ("A", "SELL", 3.0, 100.0),
            ("A", "SELL", 2.0, 100.0),
        ],
    )
    assert [r.status for r in got] == ["BAD_SIDE", "BAD_QUANTITY", "NO_PRICE", "BALANCE", "STOCK_CAP", "OVERSELL", "OK", "OVERSELL", "OK"]
    fill = 100 * 1.0005
    after = 1000 - 2 * fill
    assert got[6].virtual_balance_after == pytest.approx(after) and got[6].fill_price == fill
    assert got[8].virtual_balance_after == pytest.approx(after + 2 * 100 * 0.9995 * 0.999)


def test_cap_is_of_the_balance_before_and_dust_stays_open(spark):
    price = 300 / 1.0005  # cost of one is 30 % of 1000, but for rounding
    assert run_orders(spark, [("A", "BUY", 1.0, price)])[0].status in ("OK", "STOCK_CAP")
    assert run_orders(spark, [("A", "BUY", 0.999, price)])[0].status == "OK"
    got = run_orders(spark, [("A", "BUY", 0.1, 1.0), ("A", "BUY", 0.2, 1.0), ("A", "SELL", 0.3, 1.0), ("A", "SELL", 1e-17, 1.0)])
    assert [r.status for r in got] == ["OK", "OK", "OK", "OK"]  # 0.1 + 0.2 - 0.3 leaves dust, which can be sold
    assert run_orders(spark, [("A", "BUY", 1.0, 1000.0)])[0].status == "BALANCE"


def replayed(orders, ticks, balance):
    """Outcomes of orders, one by one, each buy against all ticks up to its time."""
    users, out = {}, []
    for o in sorted(orders, key=lambda o: (o["ts"], o["id"])):
        u = users.setdefault(o["user_id"], {"cash": balance, "held": {}})

        def price_at(ticker, ts=o["ts"]):
            seen = [(t["ts"], t["event_id"], t["price"]) for t in ticks if t["ticker"] == ticker and t["ts"] <= ts and t["price"] > 0]
            return max(seen)[2] if seen else None

        status, fill, p, n = "OK", None, o["price"], u["held"].get(o["ticker"], 0.0)
        if o["side"] == "BUY":
            fill = p * 1.0005
            worth = [q * (p if t == o["ticker"] else price_at(t)) for t, q in u["held"].items() if q > 0]
            if u["cash"] < fill * o["quantity"]:
                status = "BALANCE"
            elif (n * p + fill * o["quantity"]) / (sum(worth) + u["cash"]) > 0.3:
                status = "STOCK_CAP"
            else:
                u["cash"] -= fill * o["quantity"]
                u["held"][o["ticker"]] = n + o["quantity"]
        elif n < o["quantity"]:
            status = "OVERSELL"
        else:
            fill = p * 0.9995
            u["cash"] += fill * o["quantity"] * 0.999
            u["held"][o["ticker"]] = n - o["quantity"]
        out.append((o["id"], status, round(u["cash"], 6), None if status != "OK" else round(fill, 9)))
    return sorted(out)


def outcomes(df):
    return sorted((r.id, r.status, round(r.virtual_balance_after, 6), None if r.fill_price is None else round(r.fill_price, 9)) for r in df.collect())


def test_holdings_are_valued_at_live_prices(spark):
    """A holds 2 T0 bought at 100. While T0 stands at 100, 3 T1 at 110 are under 30 % of 1000 or so; when T0 falls to 1 without
    an order, they are over it."""
    orders = [(1, 1, "T0", "BUY", 2.0, 100.0, minutes(0)), (2, 1, "T1", "BUY", 2.6, 110.0, minutes(2))]
    users = spark.createDataFrame([(1, 1000.0)], "user_id long, balance double")
    made = lambda *ticks: spark.createDataFrame(
        [(t, minutes(m), m, p) for t, m, p in ticks],
        "ticker string, ts timestamp_ntz, event_id long, price double",
    )
    run = lambda ticks: [r.status for r in sorted(trading.execute_trades(spark.createDataFrame(orders, ORDERS), users, ticks).collect())]
    assert run(made(("T0", 0, 100.0), ("T1", 2, 110.0))) == ["OK", "OK"]
    assert run(made(("T0", 0, 100.0), ("T0", 1, 1.0), ("T1", 2, 110.0))) == ["OK", "STOCK_CAP"]
    assert run(made(("T0", 3, 100.0), ("T1", 2, 110.0))) == ["OK", "NO_PRICE"]


def test_execution_is_the_replay_in_batch_and_stream(spark, small):
    ticks = [r.asDict() for r in tables.ticks(spark, small).select("ticker", "ts", "event_id", "price").collect()]
    orders = [r.asDict() for r in tables.trades(spark, small).withColumnRenamed("fill_price", "price").collect()]
    want = replayed(orders, ticks, tables.TRADING_BALANCE)
    known = {r.id for r in tables.users(spark, small).collect()}
    users = {o["id"]: o["user_id"] for o in orders}
    got = outcomes(execute_trades(spark, small).where("status <> 'NO_USER'"))
    assert got == [w for w in want if users[w[0]] in known] and len({w[1] for w in got}) == 4
    assert outcomes(stream_plans.stream_execute_trades(spark, small)) == want


def test_accounts_go_from_batch_to_batch(spark, small, tmp_path):
    """The stream's files come one by one, so that users' accounts pass through several batches, merged or not."""
    rows = tables.trades(spark, small).withColumnRenamed("fill_price", "price").orderBy("ts", "id")
    parts = [r for r in rows.collect()]
    for i in range(5):
        spark.createDataFrame(parts[i * 36 : i * 36 + 36], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ticks = tables.ticks(spark, small).select("ticker", "ts", "event_id", "price")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    want = replayed([r.asDict() for r in parts[:180]], [r.asDict() for r in ticks.collect()], 4000.0)
    assert outcomes(streams.run_orders(stream, ticks, 4000.0, merge_every=2)) == want


def test_unknown_user(spark):
    orders = spark.createDataFrame([(1, 9, "A", "BUY", 1.0, 1.0, T0)], ORDERS)
    none = spark.createDataFrame([], "user_id long, balance double")
    assert trading.execute_trades(orders, none).collect()[0].status == "NO_USER"


def bars(spark, closes, volumes=None):
    return spark.createDataFrame(
        [("A", minutes(i), i, c, v) for i, (c, v) in enumerate(zip(closes, volumes or closes, strict=True))],
        "ticker string, ts timestamp_ntz, event_id long, close_c long, volume_c long",
    )


def last(df, column):
    return sorted(df.collect(), key=lambda r: r.event_id)[-1][column]


def test_rsi_edges(spark):
    assert last(monitor.rsi_series(bars(spark, range(100, 114))), "rsi") is None  # 14 bars
    assert last(monitor.rsi_series(bars(spark, range(100, 115))), "rsi") is None  # no loss
    assert last(monitor.rsi_series(bars(spark, range(115, 100, -1))), "rsi") == 0.0  # no gain
    up_down = [100 + (i % 2) for i in range(15)]
    assert last(monitor.rsi_series(bars(spark, up_down)), "rsi") == 50.0


def test_volume_edges(spark):
    flat = [100] * 20
    assert last(monitor.volume_series(bars(spark, flat)), "spike") is None  # 20 bars
    assert last(monitor.volume_series(bars(spark, [*flat, 300])), "spike") is False  # exactly three times
    assert last(monitor.volume_series(bars(spark, [*flat, 301])), "spike") is True


def test_stop_target_touch_and_null_limits(spark):
    held = spark.createDataFrame(
        [(1, "A", 1.0, 100.0), (2, "A", 1.0, 100.0), (3, "B", 1.0, 1.0)],
        "user_id long, ticker string, quantity double, avg_cost double",
    )
    live = spark.createDataFrame([("A", 90.0)], "ticker string, price double")
    limit = spark.createDataFrame([(1, "A", 10.0, None), (2, "A", None, -10.0)], "user_id long, ticker string, sl_pct double, tg_pct double")
    empty = lambda c: spark.createDataFrame([], f"ticker string, {c}")
    got = monitor.all_alerts(held, live, limit, empty("change double"), empty("rsi double"), empty("spike boolean")).collect()
    assert sorted((r.user_id, r.alert_type, r.message) for r in got) == [
        (1, "STOP_LOSS_BREACH", "A down from your buy price. Stop-loss at 90.00 breached."),
        (2, "TARGET_HIT", "A up from your buy price. Target at 90.00 hit."),
    ]


def test_sentiment_change_needs_two(spark):
    rows = [(1, "A", T0, 0.5), (2, "A", minutes(1), 0.1), (3, "B", T0, -1.0)]
    got = monitor.sentiment_change(spark.createDataFrame(rows, "id long, ticker string, ts timestamp_ntz, score double")).collect()
    assert [(r.ticker, r.change) for r in got] == [("A", 0.1 - 0.5)] and not got[0].change < -0.4


def test_market_hours(spark):
    utc = ["2024-01-01 03:44:59", "2024-01-01 03:45:00", "2024-01-01 10:00:00", "2024-01-01 10:00:01", "2024-01-06 05:00:00"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t),) for t in utc], "ts timestamp_ntz")
    assert [
        tuple(r)
        for r in df.select(scalars.market_open(F.col("ts")), scalars.market_open_minute(F.col("ts"))).collect()
    ] == [(False, False), (True, True), (True, True), (False, True), (False, False)]


def test_news(spark):
    rows = [(3, "b", "RESULT due", None), (1, "a", "RESULT due", None), (2, "a", "x http://y.z é!  ok", T0)]
    df = spark.createDataFrame(rows, "seq long, source string, text string, published timestamp_ntz")
    assert sorted(r.seq for r in news.first_of_each(df).collect()) == [1, 2]
    assert sorted((r.seq, r.ticker) for r in news.mentions(df, ["LT.NS", "^NSEI"]).collect()) == [(1, "LT.NS"), (3, "LT.NS")]
    assert df.where("seq = 2").select(scalars.clean_text(F.col("text"))).first()[0] == "x ! ok"
    assert sorted((r.seq, r.source_rank) for r in news.union_sources(df.where("seq = 1"), df).collect()) == [(1, 0), (1, 1), (2, 1), (3, 1)]


def test_as_of_includes_the_instant(spark):
    left = spark.createDataFrame([(1, "A", minutes(5)), (2, "A", minutes(4)), (3, "B", minutes(5))], "id long, ticker string, ts timestamp_ntz")
    right = spark.createDataFrame([("A", minutes(5), 7.0, 1), ("A", minutes(5), 8.0, 2)], "ticker string, ts timestamp_ntz, price double, o long")
    got = market.as_of(left, right, ["ticker"], "ts", ["price"], "o").collect()
    assert sorted((r.id, r.asof_price) for r in got if r.asof_price) == [(1, 8.0)] and len(got) == 3
    plan = market.as_of(left, right, ["ticker"], "ts", ["price"], "o")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_insert_if_absent_first_wins(spark):
    stored = spark.createDataFrame([("A", 1, 1.0)], "ticker string, ts int, x double")
    new = spark.createDataFrame([("A", 1, 9.0), ("A", 2, 5.0), ("A", 2, 4.0)], "ticker string, ts int, x double")
    assert sorted(map(tuple, market.insert_if_absent(stored, new, ["ticker", "ts"], "x").collect())) == [("A", 1, 1.0), ("A", 2, 4.0)]


def test_outcome(spark):
    rows = [("BUY", 10.0, 11.0), ("SELL", 2450.0, 2180.0), ("HOLD", 100.0, 102.0), ("HOLD", 100.0, 102.5), ("BUY", 1.0, None)]
    df = spark.createDataFrame(rows, "s string, b double, a double")
    assert [r[0] for r in df.select(analytics.outcome(F.col("s"), F.col("b"), F.col("a"))).collect()] == ["CORRECT", "CORRECT", "CORRECT", "WRONG", None]


def test_pushed_filters_and_pruned_columns(spark, small):

    plan = tables.trades(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan
    assert "props" in plan and "n_chars" not in plan


def test_buckets_of_time_change_nothing(spark):
    """As-of values and running sums, cut into hours, with hours that have rows of one side only or none."""
    r = random.Random(4)
    made = lambda n, hours: [(r.choice("AB"), minutes(60 * r.choice(hours) + r.randrange(60)), i, float(i)) for i in range(n)]
    schema = "k string, ts timestamp_ntz, id long, v double"
    right = spark.createDataFrame(made(40, (1, 2, 7, 30)), schema)
    left = spark.createDataFrame(made(60, (0, 2, 3, 8, 20, 31, 50)), schema).withColumnRenamed("v", "w")
    whole, cut = (sorted(map(tuple, market.as_of(left, right, ["k"], "ts", ["v"], "id", bucket=b).collect()), key=str) for b in (None, "1 hour"))
    assert whole == cut and len(cut) == 60 and any(x[-1] is None for x in cut) and any(x[-1] is not None for x in cut)
    got = {x.id: x.running for x in market.running_sum(right, ["k"], "ts", "id", F.col("v"), "1 hour").collect()}
    rows = right.collect()
    assert got == {x.id: sum(y.v for y in rows if y.k == x.k and (y.ts, y.id) <= (x.ts, x.id)) for x in rows}


def test_frames_cut_by_time_are_whole(spark):
    """Bars of uneven gaps, some days empty and some full, and the extremes of a span that crosses buckets."""
    random.seed(7)
    at, rows = dt.datetime(2024, 1, 1), []
    for i in range(160):
        at += dt.timedelta(minutes=random.choice((0, 1, 30, 700, 1440, 4000)))
        rows.append(("A", at, i, random.randrange(1, 50), random.randrange(1, 9)))
    made = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, event_id long, close_c long, volume_c long")
    rsi = {r.event_id: r.rsi for r in monitor.rsi_series(made).collect()}
    spikes = {r.event_id: r.spike for r in monitor.volume_series(made).collect()}
    change = {r.id: (r.fell, r.rose) for r in analytics.recent_change(made.selectExpr("event_id AS id", "ticker", "ts", "double(close_c) AS score")).collect()}
    extremes = sorted(tuple(r) for r in analytics.range_extremes(made.selectExpr("ticker AS key", "ts AS d", "close_c AS value"), days=3).collect())
    within = lambda i, span: [r[3] for r in rows if rows[i][1] - span <= r[1] <= rows[i][1]]
    assert len(rsi) == len(spikes) == len(change) == len(extremes) == len(rows)
    for i in range(len(rows)):
        steps = [rows[j][3] - rows[j - 1][3] for j in range(i - 13, i + 1)] if i >= 14 else []
        gain, loss = sum(max(s, 0) for s in steps), sum(max(-s, 0) for s in steps)
        assert rsi[i] == (pytest.approx(100 - 100 / (1 + gain / loss)) if loss else None)
        assert spikes[i] == (rows[i][4] * 20 > sum(r[4] for r in rows[i - 20 : i]) * 3 if i >= 20 else None)
        near = within(i, dt.timedelta(hours=2))
        assert change[i] == (rows[i][3] - max(near), rows[i][3] - min(near))
    far = [within(i, dt.timedelta(days=3)) for i in range(len(rows))]
    assert extremes == sorted(("A", r[1], r[3], max(f), min(f)) for r, f in zip(rows, far))


def test_a_model_scores_where_it_can(spark):
    rows = spark.createDataFrame([(1, "Good day"), (2, "bad day")], "seq long, text string")
    model = lambda clean: F.when(clean.contains("Good"), F.lit(0.7))
    got = {r.seq: (r.score, r.confidence) for r in news.scored(rows, {"bad": -2.5}, model).collect()}
    assert got == {1: (0.7, 1.0), 2: (-2.5 / (2.5 * 2.5 + 15) ** 0.5, 1.0)}
    assert {r.confidence for r in news.scored(rows, {"bad": -2.5}).collect()} == {0.5}


def test_lexicon_tables(spark, tmp_path):
    (tmp_path / "lexicon.txt").write_text("good\t1.9\t0.9\t[2, 2]\nbad\t-2.5\t0.6\t[-3, -2]\n\nodd\tx\n")
    lexicon = schemas.read_lexicon(spark, str(tmp_path / "lexicon.txt"))
    assert sorted(tuple(r) for r in lexicon.collect()) == [("bad", -2.5), ("good", 1.9)]
    rows = spark.createDataFrame([(1, "Good, good http://x.y bad"), (2, "GOOD bad bad"), (3, "plain"), (4, ""), (5, None)], "seq long, text string")
    got = {r.seq: r.score for r in news.scored_by_table(rows, lexicon).collect()}
    norm = lambda s: s / (s * s + 15) ** 0.5
    assert got == {1: pytest.approx(norm(1.9 - 2.5)), 2: pytest.approx(norm(1.9 - 5)), 3: 0, 4: 0, 5: 0}


def test_hue_wraps_shifts_only(spark):
    def by_hand(text):
        h = 0
        for c in text:
            shifted = (h * 32) & 0xFFFFFFFF
            h = ord(c) + (shifted - 2**32 if shifted >= 2**31 else shifted) - h
        return abs(h) % 360

    texts = ["", "T0", "RELIANCE.NS", "Customer#000000042", "a long name that wraps many times over and over"]
    rows = spark.createDataFrame([(t,) for t in texts], "name string")
    assert {r.name: r.hue for r in rows.select("name", scalars.hue(F.col("name")).alias("hue")).collect()} == {t: by_hand(t) for t in texts}


def test_markets_close_on_holidays(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 25, 6),), (dt.datetime(2024, 1, 26, 6),), (dt.datetime(2024, 1, 25, 20),)], "ts timestamp_ntz")
    assert [r[0] for r in rows.select(scalars.market_open(F.col("ts"), ["2024-01-26"])).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(scalars.market_open(F.col("ts"))).collect()] == [True, True, False]


def test_history_prices_where_users_meet(spark):
    """Positions at instants are priced and added up in place: joined prices give the same, but by a shuffle of all of them."""
    day = dt.datetime(2024, 1, 1)
    at = lambda h: day + dt.timedelta(hours=h)
    rows = [(i, i % 5, f"T{i * 7 % 4}", "SELL" if i % 3 == 2 else "BUY", float(i % 4 + 1), 10.0 + i % 6, at(i % 40)) for i in range(120)]
    trades = spark.createDataFrame(rows, "id long, user_id long, ticker string, side string, quantity double, fill_price double, ts timestamp_ntz")
    bars = [(f"T{t}", at(h), 8.0 + (h * 3 + t) % 7) for t in range(3) for h in range(t, 60, t + 1)]
    prices = spark.createDataFrame(bars, "ticker string, ts timestamp_ntz, close double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        near = history.history(trades, prices, 1000.0, "2024-02-01 00:00:00")
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(ticker#" not in "".join(x for x in plan.splitlines() if "ts#" in x.partition("hashpartitioning")[2].partition(")")[0])
        joined = history.history(trades, prices, 1000.0, "2024-02-01 00:00:00", prices_most=0)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, joined.collect())) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lexicon_words_are_added_up_where_they_are_read(spark):
    """No row for each different word of an article is kept or shuffled; several passes of a lexicon give what one gives."""
    rows = spark.createDataFrame([(i, " ".join(f"w{i * k % 50}" for k in range(40))) for i in range(30)] + [(99, None)], "seq long, text string")
    lexicon = spark.createDataFrame([(f"W{i}", (i - 20) / 10) for i in range(45)] + [("w3", 9.0)], "token string, valence double")
    found = news.scored_by_table(rows, lexicon)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("seq#" in x and "word#" in x for x in plan.splitlines() if "HashAggregate(keys" in x.partition("functions=")[0])
    want = {r.seq: r.score for r in found.collect()}
    valence = {f"w{i}": i * 10 - 200 for i in range(45)}
    for i in range(30):
        s = sum(valence.get(f"w{i * k % 50}", 0) for k in range(40)) / 100
        assert want[i] == pytest.approx(s / (s * s + 15) ** 0.5)
    assert len(want) == 31 and want[99] == 0
    assert {r.seq: r.score for r in news.scored_by_table(rows, lexicon, most_words=7).collect()} == want
