"""A table that takes batches once: replays, failures before the commit, first rows that stay."""

from __future__ import annotations

import pytest

from ledgerloom.sources.daily import FirstWins

SCHEMA = "ticker string, day int, close double"


@pytest.fixture
def table(spark, tmp_path):
    return FirstWins(spark, str(tmp_path / "t"), SCHEMA, ("ticker", "day"))


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_first_write_wins_and_replays_change_nothing(spark, table):
    assert held(table) == []
    assert table.write(rows(spark, ("A", 1, 1.0), ("A", 2, 2.0), ("A", 2, 0.5)), 0, "close")
    assert held(table) == [("A", 1, 1.0), ("A", 2, 0.5)]
    assert table.write(rows(spark, ("A", 2, 9.0), ("B", 1, 3.0)), 1, "close")
    want = [("A", 1, 1.0), ("A", 2, 0.5), ("B", 1, 3.0)]
    assert held(table) == want
    assert not table.write(rows(spark, ("C", 1, 1.0)), 1, "close") and held(table) == want


def test_a_failed_batch_leaves_nothing_and_is_written_over(spark, table, monkeypatch):
    table.write(rows(spark, ("A", 1, 1.0)), 0, "close")
    given = rows(spark, ("B", 1, 2.0), ("C", 1, 3.0))
    rows(spark, ("B", 1, 7.0), ("Z", 1, 7.0)).write.parquet(f"{table.folder}/rows/batch=1")  # as a run left it that failed before its commit
    assert held(table) == [("A", 1, 1.0)] and not table.committed(1)
    assert table.write(given, 1, "close")
    assert held(table) == [("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 3.0)]


def test_the_second_commit_of_a_batch_fails(spark, table):
    table.write(rows(spark, ("A", 1, 1.0)), 0, "close")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        spark.range(1).write.mode("error").parquet(f"{table.folder}/commits/batch=0")
