from __future__ import annotations

import hashlib
import random
import re

import pytest

from ledgerloom.llm import decontaminate as dec

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def naive(docs, bench, width=10):
    windows = {}
    for item, text in bench:
        w = words_of(text)
        for i in range(max(1, len(w) - width + 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, items = set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    items |= ids
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed):
    r = random.Random(seed)
    bench = [(i, " ".join(words(r, r.choice((3, 9, 10, 11, 25)), 30))) for i in range(12)] + [
        (50, None),
        (51, "..."),
        (None, "w1 w2"),
        (52, "W7"),
        (53, bytes("Ünï w1", "utf8").decode()),
    ]
    docs = []
    for i in range(60):
        w = words(r, r.randrange(0, 60), 30)
        if i % 3 == 0:
            b = words_of(bench[r.randrange(12)][1])
            w[5:5] = b[r.randrange(3) :]
        docs.append((i, " ".join(x.upper() if r.random() < 0.2 else x for x in w).replace(" ", r.choice((" ", ", ", "--")))))
    return docs + [(1000, None), (1001, ""), (1002, "Ünï W1 ünï"), (3, docs[3][1]), (3, docs[3][1])], bench


@pytest.mark.parametrize("block_bytes", [dec.BLOCK_BYTES, 300])
def test_same_as_brute_force(spark, make, block_bytes):
    docs, bench = cases(block_bytes)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = dec.decontaminate(make(docs), b, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == naive(docs, bench)
    kept = sorted(r.doc_id for r in dec.drop_contaminated(make(docs), b, block_bytes=block_bytes).collect())
    assert kept == sorted(d[0] for d in naive(docs, bench) if not d[5])


def test_odd_rows(spark, odd, none, make):
    b = spark.createDataFrame([(1, "one two"), (2, "lorem ipsum dolor lorem")], "item_id long, text string")
    got = dec.decontaminate(odd, b).collect()
    assert len(got) == 13 and sorted(r.n_hit for r in got)[-1] == 119_998
    assert sum(r.contaminated for r in got) == 5
    assert dec.decontaminate(none, b).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in dec.decontaminate(odd, empty).collect())
    assert dec.drop_contaminated(odd, empty).count() == 13


def test_blocks_are_read_once_and_freed(spark, make, monkeypatch):
    docs, bench = cases(5)
    b = spark.createDataFrame(bench, "item_id long, text string")
    made, gone = [], []
    real = dec.Blocks.broadcast

    def watched(self, i):
        kept = real(self, i)
        made.append(i)
        destroy = kept.destroy
        monkeypatch.setattr(kept, "destroy", lambda: (gone.append(i), destroy()))
        assert len(made) - len(gone) == 1  # one block at a time
        return kept

    monkeypatch.setattr(dec.Blocks, "broadcast", watched)
    dec.drop_contaminated(make(docs), b, block_bytes=500).count()
    assert len(made) > 2 and made == gone
