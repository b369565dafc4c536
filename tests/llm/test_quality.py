from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import quality

from .conftest import words


def corpus(make, spark, n=300):
    r = random.Random(5)
    docs = []
    for i in range(n):
        good = i % 3 == 0
        docs.append((i, " ".join(w if good or r.random() < 0.5 else "junk" for w in words(r, r.randrange(1, 60), 50))))
    return docs, make(docs), spark.createDataFrame([(i,) for i in range(0, n, 6)], "id long")


def test_weights_are_the_models_ratio(spark, make):
    docs, df, good = corpus(make, spark)
    ids = {r.id for r in good.collect()}
    raw, target = Counter(), Counter()
    for i, text in docs:
        grams = Counter(quality.ngrams(text).tolist())
        raw += grams
        target += grams if i in ids else Counter()
    a, b = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    for r in quality.importance(df, good).collect():
        want = sum(np.log((target[g] + 1) / a) - np.log((raw[g] + 1) / b) for g in quality.ngrams(docs[r.doc_id][1]).tolist())
        assert r.log_weight == pytest.approx(want, abs=1e-9)


def test_top_k_is_the_sorted_top(spark, make):
    _, df, good = corpus(make, spark)
    got = quality.importance(df, good, share=0.2).collect()
    best = sorted(got, key=lambda r: (-r.gumbel_key, r.doc_id))[:60]
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in best}
    chosen = [r.doc_id % 3 == 0 for r in got if r.selected]
    assert sum(chosen) / len(chosen) > 0.6


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [float(i) for i in range(999)], [1e300, -1e300, 0.0, 1e-300] * 5])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in {1, 2, len(values) // 2 or 1, len(values)}:
        if k <= len(values):
            assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([(4,), (None,), (4,)], "id long")
    got = quality.importance(odd, target, share=0.5).collect()
    assert len(got) == 13 and all(not r.selected and r.gumbel_key is None for r in got if r.n_grams == 0)
    assert sum(r.selected for r in got) >= 6
    assert quality.importance(none, target).count() == 0
    assert quality.importance(odd, spark.createDataFrame([], "id long")).count() == 13
