from __future__ import annotations

import random

from ledgerloom.llm import licenses
from ledgerloom.llm.common import words_of


def naive(text):
    w = [x.decode() for x in words_of(text)]
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_base_is_brute_force(make):
    r = random.Random(4)
    vocabulary = "under the mit license apache version 2 2.0 cc by nc cc-by-nc BY Nc x".split()
    docs = [
        (i, r.choice((" ", "-", ", ")).join(r.choice(vocabulary) for _ in range(r.randrange(60))))
        for i in range(80)
    ] + [(90, "cc by nc by cc by nc cc by nc")]
    got = {x.doc_id: x for x in licenses.scan_licenses(make(docs)).collect()}
    for i, text in docs:
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == naive(text)
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) and (x.n_base == 0 or x.score == 1.0) and 0 <= x.score <= 1


def test_errors_are_found_and_bounded(make):
    texts = [
        (1, "and Permision is hereby granted, free of charge, to any persan obtaining a copy of it"),
        (2, "Licensed under the GNU Generel Public Licence"),
        (3, "Permission is granted to leave"),
        (4, "the and of words alone"),
    ]
    got = {x.doc_id: x for x in licenses.scan_licenses(make(texts)).collect()}
    assert got[1].labels == "mit" and 0.9 < got[1].score < 1 and got[1].notices == "mit:1:13:2"
    assert got[2].labels == "gpl" and got[3].labels == got[4].labels == "" and got[3].score == 0.0


def test_every_notice_within_its_errors_is_found():
    search, r = licenses.NoticeSearch(), random.Random(1)
    for notice, label, k, _ in search.notices:
        for _ in range(20):
            t = list(notice)
            for _ in range(k):
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice(([], ["q"], [t[i], "q"]))
            text = "".join(t)
            found = search.search(f" zz {text} zz ")
            # the notice itself, or one of another label that fits the same place with fewer errors
            assert any(x[3] == label or x[2] < k and x[0] < 4 + len(text) and x[1] > 4 for x in found), text


def test_overlapping_notices_of_other_labels_stay():
    search = licenses.NoticeSearch()
    for text, want in (
        (" licensed under the gnu general public license version 2 ", {"gpl", "gpl-2"}),
        (" under the terms of the gnu general public license version 3 ", {"gpl", "gpl-3"}),
        (" licensed under the gnu generel public license version 3 ", {"gpl", "gpl-3"}),
        (" licensed under cc by nd ", {"cc-by-nd"}),
    ):
        assert {x[3] for x in search.search(text)} == want


def test_every_one_of_adjacent_notices_is_found():
    search, one, two = licenses.NoticeSearch(), "licensed under the mit licence", "licensed under the mit license"
    assert [x[:4] for x in search.search(f" {one} {two} ")] == [(1, 31, 1, "mit"), (32, 62, 0, "mit")]
    r = random.Random(2)
    for _ in range(20):
        line = [r.choice((one, two)) for _ in range(r.randrange(1, 9))]
        assert [x[2] for x in search.search(" " + " ".join(line) + " ")] == [int(x == one) for x in line]


def test_odd_rows(odd, none):
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == 13 and all(x.labels == "" and x.score == 0.0 and x.first_word is None for x in got)
    assert licenses.scan_licenses(none).count() == 0


def test_notices_begin_and_end_between_words():
    search = licenses.NoticeSearch()
    for text in ("small rights reserved", "all rights reservedly", "overall rights reserved", "the unlicensed under the mit licenses"):
        assert [x for x in search.search(f" {text} ") if x[2] == 0] == [], text
    assert [x[:4] for x in search.search(" so all rights reserved here ")] == [(4, 23, 0, "proprietary")]
    assert [x[3] for x in search.search("all rights reserved")] == ["proprietary"]
    assert search.search(" small rights reserved ") == []


def test_spans_are_what_brute_force_finds(make):
    """Every window of words within a notice's errors has a span of the notice's label, or of a better one, over it; every
    span is within its notice's errors."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(6)
    notices = [(n, label) for n, label in licenses.NOTICES if len(n) < 40]
    rows = []
    for i in range(40):
        n = list(r.choice(notices)[0])
        for _ in range(r.randrange(3)):
            n[r.randrange(len(n))] = r.choice("qxz")
        rows.append((i, f"so {''.join(n)} and small rights reserved by w{i}"))
    for x in licenses.scan_licenses(make(rows)).collect():
        words = [w.decode() for w in words_of(rows[x.doc_id][1])]
        spans = [(y.split(":")[0], *map(int, y.split(":")[1:])) for y in x.notices.split(",") if y]
        for label, a, b, errors in spans:
            assert min(distance(" ".join(words[a : b + 1]), n) for n, own in licenses.NOTICES if own == label) == errors
        for n, label in notices:
            k = max(1, len(n) // licenses.CHARS_PER_ERROR)
            m = len(n.split())
            for a in range(len(words)):
                for b in range(a + max(1, m - 1), min(len(words), a + m + 1) + 1):
                    if distance(" ".join(words[a:b]), n) <= k:
                        assert any(p < b and q >= a for _, p, q, _ in spans), (n, words[a:b])
