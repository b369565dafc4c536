"""Gates of an order: each status, its limits, and their order."""

from __future__ import annotations

from datetime import datetime

import pytest

from ledgerloom.operators.trading import DESIGN, Account, Gates, execute_trades

OPEN = datetime(2024, 1, 2, 6, 0)  # a Tuesday, 11:30 in the market's zone
GATES = Gates(tickers=r"[A-Z]+\.NS", hours=DESIGN.hours, order_share=0.20, sector_share=0.40, sectors={"A.NS": "x", "B.NS": "x", "C.NS": "y"})


def account(**held):
    return Account(1000.0, {f"{k}.NS": [q, 1.0] for k, q in held.items()}, GATES)


@pytest.mark.parametrize("status, held, order", [
    ("OK", {}, ("A.NS", "BUY", 1.0, 100.0, {}, OPEN)),
    ("BAD_TICKER", {}, ("A.BO", "BUY", 1.0, 100.0, {}, OPEN)),
    ("BAD_TICKER", {}, (None, "SELL", 1.0, 100.0, {}, OPEN)),
    ("CLOSED", {}, ("A.NS", "BUY", 1.0, 100.0, {}, datetime(2024, 1, 6, 6, 0))),
    ("CLOSED", {}, ("A.NS", "SELL", 1.0, 100.0, {}, datetime(2024, 1, 2, 3, 44, 59))),
    ("OK", {}, ("A.NS", "BUY", 1.0, 100.0, {}, datetime(2024, 1, 2, 3, 45))),
    ("OK", {}, ("A.NS", "BUY", 1.0, 100.0, {}, datetime(2024, 1, 2, 10, 0))),
    ("CLOSED", {}, ("A.NS", "BUY", 1.0, 100.0, {}, datetime(2024, 1, 2, 10, 0, 1))),
    ("BAD_SIDE", {}, ("A.NS", "HOLD", 1.0, 100.0, {}, OPEN)),
    ("BAD_QUANTITY", {}, ("A.NS", "BUY", 0.0, 100.0, {}, OPEN)),
    ("NO_PRICE", {}, ("A.NS", "BUY", 1.0, None, {}, OPEN)),
    ("BALANCE", {}, ("A.NS", "BUY", 20.0, 100.0, {}, OPEN)),
    ("ORDER_CAP", {}, ("A.NS", "BUY", 2.0, 100.0, {}, OPEN)),  # 200.1 of 1000
    ("OK", {}, ("A.NS", "BUY", 1.99, 100.0, {}, OPEN)),
    ("STOCK_CAP", {"A": 4.0}, ("A.NS", "BUY", 1.0, 100.0, {}, OPEN)),  # 500 of 1400
    ("SECTOR_CAP", {"A": 2.5, "B": 2.5}, ("A.NS", "BUY", 1.4, 100.0, {"B.NS": 120.0}, OPEN)),  # 690 of 1550, 390 in one stock
    ("OK", {"A": 2.5, "C": 2.5}, ("A.NS", "BUY", 1.4, 100.0, {"C.NS": 120.0}, OPEN)),
    ("NO_PRICE", {"B": 1.0}, ("A.NS", "BUY", 1.0, 100.0, {}, OPEN)),
    ("OVERSELL", {}, ("A.NS", "SELL", 1.0, 100.0, {}, OPEN)),
    ("OK", {"A": 9.0}, ("A.NS", "SELL", 9.0, 100.0, {}, OPEN)),  # sales aren't capped
])
def test_each_status(status, held, order):
    a = account(**held)
    before = (a.balance, {k: list(v) for k, v in a.held.items()})
    got, fill = a.execute(*order)
    assert got == status and (fill is not None) == (status == "OK")
    if status != "OK":
        assert (a.balance, a.held) == before


def test_the_design_limits():
    assert (DESIGN.order_share, DESIGN.sector_share, DESIGN.hours) == (0.20, 0.40, (555, 930))


def test_without_gates_nothing_changes(spark):
    orders = spark.createDataFrame(
        [(1, 7, "x", "BUY", 1.0, 100.0, datetime(2024, 1, 6)), (2, 7, "x", "BUY", 1.0, 100.0, None), (3, 8, "x", "BUY", 1.0, 1.0, None)],
        "id long, user_id long, ticker string, side string, quantity double, price double, ts timestamp_ntz",
    )
    balances = spark.createDataFrame([(7, 1000.0)], "user_id long, balance double")
    assert {r.id: r.status for r in execute_trades(orders, balances).collect()} == {1: "OK", 2: "OK", 3: "NO_USER"}
    assert {r.id: r.status for r in execute_trades(orders, balances, gates=GATES).collect()} == {1: "BAD_TICKER", 2: "BAD_TICKER", 3: "NO_USER"}


def test_the_query_reaches_the_gates(spark, small):
    from ledgerloom.plans.portfolio import execute_gated

    found = {r.status for r in execute_gated(spark, small).select("status").distinct().collect()}
    assert {"OK", "BAD_TICKER", "CLOSED", "OVERSELL"} <= found
