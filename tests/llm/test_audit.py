from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from ledgerloom.llm import audit

from .conftest import SCHEMA, document, words

LABELS = "doc_id long, quality int, toxic int"


def fails(text: str) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        x
        for x, bad in zip(
            "ABCD",
            (
                len(w) < 200,
                100 * len(set(w)) < 50 * len(w),
                100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                re.search("[#$%&*|]", text),
            ),
            strict=True,
        )
        if bad
    }


def naive(docs, labels):
    """Every order is applied to the documents one filter after the other."""
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        text = text or ""
        repeat = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((i, part or "", fails(text) | ({"E"} if repeat else set())))
    out, shares = [], Counter()
    for part in {r[1] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shares[part, f] += len(removed)
                out.append(
                    (
                        part,
                        "".join(order),
                        step,
                        len(left),
                        len(removed),
                        sum(f in r[2] for r in gone),
                        sum(r[1] == part and r[2] == {f} for r in rows),
                        sum(r[0] in good for r in removed),
                        sum(r[0] in toxic for r in removed),
                        f,
                    )
                )
                gone += removed
    return sorted((*row[:-1], shares[row[0], row[-1]]) for row in out)


def table_of(spark, docs):
    """The documents with their part as source, beside columns of clashing names."""
    rows = [document(i, text) for i, text, _ in docs]
    return spark.createDataFrame([(*r[:3], part, *r[4:]) for r, (*_, part) in zip(rows, docs, strict=True)], SCHEMA)


def got(spark, docs, labels):
    counts = audit.failed_sets(table_of(spark, docs), spark.createDataFrame(labels, LABELS))
    return sorted(tuple(r) for r in audit.interactions(counts).drop("filter").collect())


def test_same_as_every_order_applied(spark):
    r = random.Random(7)
    docs = []
    for i in range(80):
        w = words(r, r.choice((3, 150, 199, 200, 201, 260)), r.choice((40, 5000)))
        if r.random() < 0.3:
            w[0] = "#" + w[0]
        text = " ".join(x.upper() if r.random() < 0.03 else x for x in w)
        docs.append((i, text, r.choice(("a", "b", None, ""))))
    docs += [(100 + i, docs[i * 3][1], r.choice("ab")) for i in range(15)]
    labels = [(r.randrange(130), r.choice((0, 1, None)), r.choice((0, 1, None))) for _ in range(90)]
    assert got(spark, docs, labels) == naive(docs, labels)


def test_odd_rows(spark):
    long = "word " * 200_000
    docs = [
        (1, None, "a"),
        (2, "", "a"),
        (None, "", "a"),
        (None, None, None),
        (3, long, "b"),
        (4, long, "a"),
        (4, long, "a"),
        (3, long, "b"),
        (5, "Ü" * 60 + "A", "b"),
        (6, "\x1c\x85 \xa0" * 300, "b"),
        (7, "a\x00b " * 300, "b"),
    ]
    labels = [(4, 1, None), (4, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 1), (1, 1, 1)]
    assert got(spark, docs, labels) == naive(docs, labels)


def test_exact_limits():
    assert fails(" ".join(map(str, range(199)))) == {"A"} and audit.failures(" ".join(map(str, range(199))).encode()) == 1
    for text in (
        "a " * 200 + " ".join(map(str, range(198))),
        "a " * 200 + " ".join(map(str, range(199))),
        "A" + "é" * 49,
        "A" + "é" * 48,
        "|",
        "",
    ):
        assert audit.failures(text.encode()) == sum(1 << "ABCD".index(f) for f in fails(text))


def test_no_rows_and_no_labels(spark):
    assert got(spark, [], []) == []
    docs = [(1, "x", "a")]
    assert got(spark, docs, []) == naive(docs, [])


def test_path_counts():
    reach, leave = audit.path_counts(4)
    assert reach[15] == leave[0] == 24 and reach[0b101] == 2 and leave[0b1] == 6
    assert all(reach[s] * leave[s] <= 24 for s in range(16))


@pytest.mark.parametrize("n", [1, 3])
def test_any_number_of_filters(spark, n):
    counts = spark.createDataFrame([("p", m, m + 1, 0, 0) for m in range(1 << n)], "part string, fails int, n long, good long, toxic long")
    rows = audit.interactions(counts, "XYZ"[:n]).collect()
    orders = list(permutations(range(n)))
    assert len(rows) == n * len(orders)
    total = {"XYZ"[f]: sum(m + 1 for o in orders for m in range(1 << n) if m >> f & 1 and not any(m >> g & 1 for g in o[: o.index(f)])) for f in range(n)}
    assert all(r.shapley == total[r["filter"]] for r in rows)
