from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerloom.llm import jaccard
from ledgerloom.llm.components import components

from .conftest import words


def naive(docs):
    """doc_id -> (shingles, smallest id reachable), by comparing all pairs."""
    sets = []
    for i, text in docs:
        w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    least = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and least[i] != least[j] and a and 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return {(i, len(s), least[i]) for i, s in sets}


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return w


def corpus(seed):
    r = random.Random(seed)
    docs, base, passage = [], words(r, 120, 5000), words(r, 60, 5000)
    for i in range(50):  # one large group of near copies, some of them far apart
        docs.append(edited(r, base, r.randrange(0, 6)))
    for i in range(40):  # a passage that many unlike documents share
        w = words(r, r.randrange(10, 150), 5000)
        docs.append(w[:5] + passage + w[5:])
    for i in range(60):
        w = words(r, r.randrange(1, 200), 5000)
        docs += [w, edited(r, w, r.randrange(0, 4)), w]
    for i in range(15):  # chains
        w = words(r, 80, 5000)
        docs += [w[k : k + 60] for k in range(0, 20, 4)]
    docs += [["a"], ["A"], ["a", "b"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d"]]
    r.shuffle(docs)
    return [(3 * i + 1, r.choice((" ", "\n", "  ")).join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("small_limits", [False, True])
def test_same_as_all_pairs(make, monkeypatch, small_limits):
    if small_limits:  # hot shingles, large keys cut into blocks, ids by join
        for name, value in {"HOT_LEAST": 8, "LOCAL_LEAST": 2, "CHUNK": 3000, "BLOCK": 8, "ANCHORS": 1, "IDS_MOST": 3}.items():
            monkeypatch.setattr(jaccard, name, value)
    docs = corpus(7)
    got = jaccard.near_duplicates(make(docs)).collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == naive(docs)


def test_keep_one_of_each(make):
    docs = corpus(8)[:120]
    docs += [docs[0], docs[0], (10_000, None), (10_001, "")]
    kept = [r.doc_id for r in jaccard.keep_one_of_each(make(docs)).collect()]
    assert sorted(kept) == sorted({i for i, _, c in naive(docs) if i == c})


def test_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()), key=str)
    assert got.count((5, 1, 5)) == 2 and (10, 1, 5) in got and (None, 1, 5) in got and (None, 0, None) in got
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (4, 3, 4) in got and len(got) == 13
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.keep_one_of_each(none).count() == 0


def some_sets(r, sizes, copies=6):
    base = [r.integers(0, 2**63, n, dtype=np.uint64) for n in sizes]
    return [np.unique(np.concatenate([b[r.random(len(b)) > r.random() * 0.25], r.integers(0, 2**63, 2, dtype=np.uint64)])) for b in base for _ in range(copies)]


def linked(a, b):
    common = len(np.intersect1d(a, b))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def pairs_of(sets, side=None, done=lambda a, b: False):
    side = np.full(len(sets), 2) if side is None else side
    n = np.array([len(s) for s in sets])
    found = jaccard.unit_pairs(side, n, [jaccard.bitmap_of(s) for s in sets], np.array([s[0] for s in sets]), done)
    return [(int(a), int(b)) for p, q in found for a, b in zip(p, q, strict=True)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("two_sides", [False, True])
def test_trees_miss_no_link(seed, two_sides):
    r = np.random.default_rng(seed)
    sets = some_sets(r, r.integers(2, 300, 40))
    side = r.integers(0, 2, len(sets)) if two_sides else None
    found = pairs_of(sets, side)
    assert two_sides or len(found) == len({frozenset(p) for p in found})  # each pair once
    got = {frozenset(p) for p in found}
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]) and (not two_sides or side[i] != side[j]):
                assert frozenset((i, j)) in got
    assert len(got) < 0.05 * len(sets) ** 2


@pytest.mark.parametrize("size", [500, 2000, 20_000])
def test_trees_prune_whatever_the_size(size):
    r = np.random.default_rng(1)
    sets = some_sets(r, [size] * 16, copies=2)
    asked = []
    found = pairs_of(sets, done=lambda a, b: asked.append(len(a) * len(b)) or False)
    assert all(i // 2 == j // 2 for i, j in found)  # no two unlike sets reach a comparison


def test_a_group_just_below_the_threshold_gives_few_links():
    r = np.random.default_rng(2)
    for share, most in ((0.8, 10), (0.93, 199)):  # similarities of about 0.65 and 0.79
        base = r.integers(0, 2**63, 400, dtype=np.uint64)
        sets = []
        for _ in range(200):
            own = base[r.random(len(base)) < share]
            sets.append(np.unique(np.concatenate([own, r.integers(0, 2**63, 20, dtype=np.uint64)])))
        links = jaccard.unit_links(np.full(200, 2), np.arange(200), sets)
        assert len(links) <= most and all(linked(sets[a], sets[b]) for a, b in links)
        least = list(range(200))
        for a, b in links:
            x, y = least[a], least[b]
            least = [min(x, y) if c in (x, y) else c for c in least]
        for i in range(0, 200, 7):
            for j in range(i):
                assert not linked(sets[i], sets[j]) or least[i] == least[j]


def test_components_are_not_asked_again():
    r = np.random.default_rng(3)
    sets = [np.unique(b[r.random(100) > 0.05]) for b in r.integers(0, 2**63, (4, 100), dtype=np.uint64) for _ in range(10)]
    comp = np.arange(len(sets)) // 10
    assert jaccard.unit_links(np.full(40, 2), comp, sets) == []
    n, bitmaps = np.array([len(s) for s in sets]), [jaccard.bitmap_of(s) for s in sets]
    assert len(jaccard.unit_candidates(np.full(40, 2), comp, n, bitmaps)) == 0
    alone = np.where(np.arange(40) % 10 == 0, 100 + np.arange(40), comp)
    assert set(jaccard.unit_candidates(np.full(40, 2), alone, n, bitmaps).tolist()) >= {0, 10, 20, 30}


def test_number_of_keys():
    assert [jaccard.n_keys(100, h) for h in (0, 25, 50, 90)] == [16, 20, 32, 32]


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    least = {i: i for pair in links for i in pair}
    for _ in range(len(least)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: c for i, c in least.items() if i != c} == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def unlinked(n, seed, changed=9):
    """Documents of one group that share keys; at 9 of 300 words changed similarities are 0.53 to 0.68."""
    r, base, out = random.Random(seed), [f"w{i}" for i in range(300)], []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(300), changed):
            w[k] = f"x{r.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_rows_of_an_unlinked_group_grow_with_it(make, monkeypatch):
    """Rows that enter the search of the second wave at most double when the group does."""
    seen, real = [], jaccard.candidates_by_unit

    def counted(rows):
        rows = jaccard.checkpointed(rows)
        seen.append(rows.count())
        return real(rows)

    monkeypatch.setattr(jaccard, "candidates_by_unit", counted)
    totals = []
    for n in (400, 800):
        seen.clear()
        assert jaccard.near_duplicates(make(unlinked(n, 1))).where("doc_id <> component_id").count() == 0
        totals.append(sum(seen))
    assert totals[1] <= 2.2 * totals[0]


@pytest.mark.parametrize("coarse", [jaccard.COARSE, 30])
def test_no_link_is_lost_about_the_threshold(make, monkeypatch, coarse):
    """Similarities from 0.70 to 0.80, in blocks of 16 and coarse units of 30 or all, against all pairs."""
    for name, value in {"BLOCK": 16, "COARSE": coarse, "ANCHORS": 1, "FIRST": 1}.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = [(1000 * k + i, t) for k, changed in enumerate((4, 5, 6)) for i, t in unlinked(60, k, changed)]
    got = jaccard.near_duplicates(make(docs)).collect()
    assert {tuple(r) for r in got} == naive(docs)
