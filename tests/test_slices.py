"""Average cost by a scan that composes: against the fold trade by trade, with hot pairs, ties, oversells and dust."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.operators import positions

SCHEMA = "id long, user_id long, ticker string, side string, quantity double, fill_price double, ts timestamp_ntz"


def trades(seed, n, steps):
    r, at, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(minutes=r.choice((0, 0, 7, 400)))
        hot = r.random() < 0.5
        out.append((i, 1 if hot else r.randrange(5), "A" if hot else r.choice("AB"), r.choice(("BUY", "BUY", "SELL")), r.choice(steps), r.randrange(1, 99) / 1.0, at))
    return out


def fold(rows):
    """Each trade after the other."""
    state, out = {}, {}
    for i, u, k, side, n, p, at in sorted(rows, key=lambda t: (t[6], t[0])):
        q, a = state.get((u, k), (0.0, 0.0))
        d = n if side == "BUY" else -n
        if q + d <= 0:
            q, a = 0.0, 0.0
        elif d > 0:
            q, a = q + d, (q * a + d * p) / (q + d)
        else:
            q += d
        state[u, k] = out[i] = (q, a)
    return out


@pytest.mark.parametrize("span", ["1 hour", "1 day", "30 days"])
def test_slices_equal_the_fold(spark, span):
    rows = trades(3, 600, (1.0, 2.0, 5.0, 40.0))
    want = fold(rows)
    got = positions.sliced_states(spark.createDataFrame(rows, SCHEMA), span).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.qty == want[r.id][0] and r.avg == pytest.approx(want[r.id][1], rel=1e-9, abs=1e-9)


def test_fractions_to_a_tolerance(spark):
    rows = trades(5, 300, (0.1, 0.2, 0.3, 1.7))
    want = fold(rows)
    near = {r.id: r for r in positions.sliced_states(spark.createDataFrame(rows, SCHEMA), "6 hours").collect()}
    same = [i for i in want if abs(near[i].qty - want[i][0]) < 1e-9 and abs(near[i].avg * near[i].qty - want[i][1] * want[i][0]) < 1e-6]
    assert len(same) == len(want)


def test_hot_pairs_only_are_cut(spark):
    rows = trades(8, 500, (1.0, 3.0))
    given = spark.createDataFrame(rows, SCHEMA)
    want = fold(rows)
    got = {r.id: (r.qty, r.avg) for r in positions.split_states(given, 100).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], rel=1e-9) for i in want)
    exact = {r.id: (r.qty, r.avg) for r in positions.split_states(given).collect()}
    assert exact == want  # no pair is hot: the same bits


def test_no_pair_lies_in_one_task(spark):
    """Rows of the hottest pair in the last step: in many partitions, none with a large share."""
    rows = [(i, 1, "A", "BUY", 1.0, 2.0, datetime(2024, 1, 1) + timedelta(minutes=30 * i)) for i in range(2000)]
    out = positions.sliced_states(spark.createDataFrame(rows, SCHEMA).repartition(3))
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4 and max(counts) < 1000


def test_empty(spark):
    assert positions.sliced_states(spark.createDataFrame([], SCHEMA)).count() == 0
    assert positions.split_states(spark.createDataFrame([], SCHEMA)).count() == 0
