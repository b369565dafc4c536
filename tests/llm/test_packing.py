from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


HARD = [
    "Don't WE'RE o', it's; '' 'sx ... a.b.c, x!? \"quoted.\" (end.) e.g.: 12,000.5",
    "H̱ ẖ É, é. İstanbul STRASSE ß ſ K K",
    "a b c\u0085d\x1ce\x0bf　g​h",
    "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y A<|endoftext|>.",
    "漢字かな。カナ、 \U0001f600\U0001f600! ñ. É, été. ǅ ﬁ.",
    "\x00 \x00a ,. .,\n\n.\t;",
    "日本" * 500 + "." * 300 + "A" * 200 + "é" * 200,
    "1 22 333, 4th x2y ²³ ①.",
    "",
    " \n\t ",
]


def test_ids_are_the_librarys(library):
    r = random.Random(3)
    alphabet = ["a", "B", "é", "É", ".", ",", "'", " ", "\n", "́", "̱", "1", "İ", "<|", "|>", "s", "t", "漢", "!", " "]
    texts = HARD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(600)]
    tokens = packing.Tokens(PATH, {})
    assert [g.tolist() for g in tokens.of(pa.array([*texts, "Last."]).slice(len(HARD), 300))] == [
        library.encode(t, add_special_tokens=False).ids for t in texts[len(HARD) : len(HARD) + 300]
    ]
    for _ in range(2):  # the second time from the memo
        got = tokens.of(pa.array([*texts, None]))
        assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_a_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 3)
    tokens = packing.Tokens(PATH, {})
    got = tokens.of(pa.array(HARD))
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in HARD] and len(tokens.memo) <= 3


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing_is_a_near_equal_partition(k):
    r = random.Random(k)
    for n in (1, 2, 5, 40, 200):
        sizes = np.array([r.randrange(1, 1000) for _ in range(n)])
        window, sums = packing.differencing(sizes, k)
        assert [sizes[window == w].sum() for w in range(k)] == sums.tolist()
        if n >= 20 * k:
            assert sums.max() - sums.min() <= 20


def test_two_windows_as_in_the_published_example():
    _, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]


def test_windows_rise_when_capacity_is_exceeded():
    window, sums = packing.dealt(np.array([60, 60, 60]), 100)
    assert len(sums) == 3 and sorted(window.tolist()) == [0, 1, 2]
    _, sums = packing.dealt(np.array([50, 50, 50, 50]), 100)
    assert sums.tolist() == [100, 100]


def test_levelled_sequences_hold_every_token_once_without_padding():
    r = random.Random(5)
    for n, most, capacity in ((1, 99, 100), (3, 100, 100), (300, 100, 100), (2000, 10, 100), (50, 4096, 4096), (64, 2, 64)):
        sizes = np.array([r.randrange(1, most + 1) for _ in range(n)])
        sequences = packing.levelled(sizes, capacity)
        spans = sorted(p for s in sequences for p in s)
        for i, size in enumerate(sizes):
            at = 0
            for _, start, length in (p for p in spans if p[0] == i):
                assert start == at and length > 0
                at += length
            assert at == size
        lengths = [sum(p[2] for p in s) for s in sequences]
        assert all(x == capacity or x & (x - 1) == 0 for x in lengths) and max(lengths) <= capacity


def check(rows, docs, library):
    """rows: doc_id, start, length, ids_crc32 or ids, doc_tokens, sequence_id, offset against the library's ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    expected = defaultdict(list)
    for doc_id, text in docs:
        expected[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    assert set(by_doc) == set(expected)
    for doc_id, pieces in by_doc.items():
        if len(expected[doc_id]) == 1:
            ids, at = expected[doc_id][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
                part = np.array(ids[at : at + p.length], "<u4").tobytes()
                assert p.ids_crc32 == zlib.crc32(part)
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, expected[doc_id]))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at < 4096 and at & (at - 1) == 0


def test_query_against_the_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    df = packing.op12_packing(spark, small)
    assert dict(df.dtypes)["ids_crc32"] == "bigint" and df.columns[:3] == ["doc_id", "start", "length"]
    check(df.collect(), docs, library)


def test_odd_rows(spark, odd, none, library):
    from pyspark.sql import functions as F

    rows = packing.packed(odd, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], library)
    assert packing.packed(none, PATH).count() == 0


def test_many_groups_and_whole_sequences(spark, make, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 9000)
    monkeypatch.setattr(packing, "GROUP_TAILS", 50)
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(("one", "two", "Three,", "été.")) for _ in range(r.choice((1, 3, 700, 2000, 9000))))) for i in range(150)]
    pieces = packing.packed(make(docs), PATH)
    rows = packing.sequences(pieces).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    total = pieces.groupBy("sequence_id").count().count()
    assert total == len(rows)


def test_stretches_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 3)
    monkeypatch.setattr(packing, "ROWS_BYTES", 10)
    texts = pa.array(["a" * n if n >= 0 else None for n in (1, 2, 3, 4, 5, 6, 30, 2, -1, 11, 0, 0, 0, 0)]).slice(1)
    got = list(packing.stretches(texts))
    assert [at for at, _ in got] == [0, *[at + n for at, n in got][:-1]] and got[-1][0] + got[-1][1] == len(texts)
    sizes = [[len(x or "") for x in texts.slice(at, n).to_pylist()] for at, n in got]
    assert all(len(s) <= 3 and (sum(s) <= 10 or len(s) == 1) for s in sizes)
    assert list(packing.stretches(pa.array([], pa.string()))) == []
