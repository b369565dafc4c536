from __future__ import annotations

from ledgerloom.llm import registry
from tests.clean import run_clean


def test_all_operators(small, tmp_path):
    run_clean(sorted(registry.queries()), small, tmp_path)
