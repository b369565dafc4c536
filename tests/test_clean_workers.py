from __future__ import annotations

from tests.clean import run_clean


def test_queries_with_python_workers(small, tmp_path):
    run_clean(["avg_cost_positions", "avg_cost_sliced", "execute_trades", "mention_match_many", "stream_monitor", "stream_cooldown", "stream_price_expiry"], small, tmp_path)
