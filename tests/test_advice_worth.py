"""Engagement, the return of advice and portfolio risk against plain statements of the same rules."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

from ledgerloom.operators import advice

BEGAN = datetime(2024, 1, 1)
ALERTS = "id long, user_id long, ticker string, alert_type string, created_at timestamp_ntz"
TRADES = "id long, user_id long, ticker string, side string, fill_price double, ts timestamp_ntz"


def test_answers_are_one_to_one(spark):
    r = random.Random(2)
    at = lambda: BEGAN + timedelta(minutes=15 * r.randrange(800))
    alerts = [(i, r.randrange(2), r.choice("AB"), "X", at()) for i in range(120)]
    seen = set()
    alerts = [a for a in alerts if (a[1], a[2], a[4]) not in seen and not seen.add((a[1], a[2], a[4]))]
    trades = [(1000 + i, r.randrange(2), r.choice("AB"), r.choice(("BUY", "SELL")), float(i), at()) for i in range(150)]
    want = {}
    for t in sorted(trades, key=lambda t: (t[5], t[0])):
        before = [a for a in alerts if a[1:3] == t[1:3] and a[4] < t[5]]
        if before:
            a = max(before, key=lambda a: a[4])
            if t[5] <= a[4] + timedelta(hours=24) and a[0] not in want:
                want[a[0]] = t[0]
    got = advice.answers(spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(trades, TRADES)).collect()
    assert {g.id: g.trade_id for g in got} == want and len(set(want.values())) == len(want) > 20


def test_loss_is_unknown_beyond_the_data(spark):
    ticks = [(1, BEGAN, "A", 10.0), (2, BEGAN + timedelta(days=7), "A", 12.0), (3, BEGAN + timedelta(days=7, hours=1), "A", 1.0)]
    answered = spark.createDataFrame(
        [(1, "BUY", 11.0, BEGAN, "A"), (2, "SELL", 11.0, BEGAN, "A"), (3, "BUY", 12.5, BEGAN, "A"), (4, "BUY", 11.0, BEGAN + timedelta(hours=2), "A")],
        "id long, side string, fill_price double, ts timestamp_ntz, ticker string",
    )
    got = advice.lost(answered, spark.createDataFrame(ticks, "event_id long, ts timestamp_ntz, ticker string, price double"))
    assert {r.id: r.loss for r in got.collect()} == {1: False, 2: True, 3: True, 4: None}


def test_types_without_answers_or_ratings(spark):
    alerts = spark.createDataFrame([(1, 1, "A", "X", BEGAN), (2, 1, "A", "Y", BEGAN)], ALERTS)
    results = spark.createDataFrame([(1, None)], "id long, loss boolean")
    ratings = spark.createDataFrame([("Y", True), ("Y", False), ("Z", True)], "alert_type string, is_positive boolean")
    got = {r.alert_type: tuple(r)[1:] for r in advice.engagement(alerts, results, ratings).collect()}
    assert got == {"X": (1, 1, 100.0, 0, 0, None, 0, 0), "Y": (1, 0, 0.0, 0, 0, None, 2, 1)}


def test_following_signals(spark):
    day = lambda n, h=0: BEGAN + timedelta(days=n, hours=h)
    signals = [(1, "A", "BUY", day(0, 5)), (2, "A", "HOLD", day(1, 5)), (3, "A", "SELL", day(2, 5)), (4, "B", "BUY", day(1, 0)), (5, "A", "BUY", day(3, 0))]
    returns = [(t, day(n), ret) for n, a, b in ((1, 0.1, 0.5), (2, -0.2, 0.4), (3, 0.3, -0.1), (4, -1.0, -1.0), (5, 0.5, 0.5)) for t, ret in (("A", a), ("B", b))]
    daily = advice.followed(
        spark.createDataFrame(signals, "id long, ticker string, signal string, created_at timestamp_ntz"),
        spark.createDataFrame(returns, "ticker string, bar_ts timestamp_ntz, ret double"),
    )
    rows = advice.equity_curve(daily, days=2).orderBy("bar_ts").collect()
    assert [(r.n_held, r.r) for r in rows] == [(1, 100000), (2, 100000), (1, -100000), (2, -1000000), (2, 500000)]
    assert [r.equity for r in rows] == [1.1, 1.21, 1.089, 0.0, 0.0]
    assert [r.sharpe for r in rows[:2]] == [None, None]  # one day; two equal ones
    a, b = 0.1, -0.1
    assert rows[2].sharpe == 0.0 and rows[4].sharpe == round((-1.0 + 0.5) / 2 / math.sqrt(((-1.0 + 0.25) ** 2 + (0.5 + 0.25) ** 2)), 6) and a == -b


def test_portfolio_var(spark):
    r = random.Random(3)
    days = [BEGAN + timedelta(days=i) for i in range(50)]
    returns = [(t, d, round(r.uniform(-0.4, 0.4), 3)) for t in "AB" for d in days if t == "A" or d != days[7]]
    held = [(1, "A", 100.0), (1, "B", 300.0), (2, "B", 50.0), (3, "C", 10.0)]
    got = advice.portfolio_var(
        spark.createDataFrame(held, "user_id long, ticker string, current_value double"),
        spark.createDataFrame(returns, "ticker string, bar_ts timestamp_ntz, ret double"),
    ).collect()
    for row in got:
        mine = {t: v for u, t, v in held if u == row.user_id}
        moves = {}
        for t, d, ret in returns:
            if t in mine:
                moves[d] = moves.get(d, 0) + mine[t] * ret
        worst = sorted(moves.values())[math.ceil(len(moves) * 0.05) - 1] / sum(mine.values())
        assert abs(row.var_5 - worst) < 2e-6 and row.within == (row.var_5 >= -0.15) and row.n_days == len(moves)
    assert {row.user_id for row in got} == {1, 2}
