from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from ledgerloom.llm import conversations as conv

SCHEMA = "conv_id long, turn int, role string, text string, segment string, n string, cost string, conv string"
BLANKS = "\x20\t\n\x0b\x0c\r"


def damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[c] += [(t, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def classified(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        solid = text.strip(BLANKS)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def edited(rows):
    """The least (cost, audit) and the repaired turns, by whole strings over all positions and states."""
    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, said) in list(best.items()):
                own = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
                found = (cost + 5, audit + "I", [*said, f"{own}:"])
                if own[0] not in best or found[:2] < best[own[0]][:2]:
                    best[own[0]] = found
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, said) in best.items():
            steps = [(state, 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for new in ("user", "assistant"):
                    if (state + new[0]) in ("u", "su", "ua", "au"):
                        steps.append((new[0], 1 + extra, "R", new))
                if state + role[:1] in ("s", "u", "su", "ua", "au") and role[:1]:
                    steps.append((role[0], extra, "K", role))
            for new, more, mark, own in steps:
                found = (cost + more, audit + mark, said + [f"{own}:{text}"] * (own is not None))
                if new not in after or found[:2] < after[new][:2]:
                    after[new] = found
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def naive(rows):
    out, left = [], damage(rows)
    for c in {r[0] for r in rows}:
        own = left.get(c, [])
        marked = classified(own)
        turns = {t for t, *_ in own if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:], strict=False)]
        cost, audit, said = edited(marked)
        out.append(
            (
                c,
                max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")),
                sum(p not in ("su", "ua", "au") for p in pairs),
                cost,
                audit,
                hashlib.sha256("\n".join(said).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def got(spark, rows):
    given = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in conv.repair(given).collect()), key=repr)


def random_rows(seed, n, most=12):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            role = r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "User"))
            text = r.choice(("Hi.", "Yes!", "no", "why?  ", " \n", "", "a. b", None, "Ü.", f"t{t}."))
            rows.append((c, None if r.random() < 0.05 else t + (r.random() < 0.1) * r.randrange(3), role, text))
    return rows


@pytest.mark.parametrize("limit", [conv.SEGMENT_ROWS, 3])
def test_same_as_whole_strings(spark, monkeypatch, limit):
    """With segments of three rows most conversations span several."""
    monkeypatch.setattr(conv, "SEGMENT_ROWS", limit)
    rows = random_rows(limit, 120) + [(1000 + k, t, "user" if t % 2 == 0 else "assistant", f"x{t}.") for k in range(3) for t in range(60)]
    assert got(spark, rows) == naive(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(conv, "SEGMENT_BYTES", 10_000)
    rows = [
        (None, 1, "user", "a."),
        (None, None, None, None),
        (None, 2, "assistant", "b."),
        (1, None, "user", "x."),
        (1, None, "user", "x."),
        *[(2, 5, "user", "same.")] * 50,
        (2, 6, "assistant", "long " * 100_000),
        (2, 7, "assistant", "long " * 100_000 + "."),
        (3, 2**31 - 1, "user", "x."),
        (3, -(2**31), "assistant", "y."),
        *[(c, 0, "user", "z.") for c in range(10, 60)],  # some of them vanish
    ]
    assert got(spark, rows) == naive(rows)
    assert any(r[7] == "" and r[8] == hashlib.sha256().hexdigest() for r in got(spark, rows))
    assert got(spark, []) == []


def test_one_conversation_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(conv, "SEGMENT_ROWS", 50)
    r = random.Random(2)
    rows = [(7, t, r.choice(("user", "assistant", "tool")), r.choice(("a", "b")) + r.choice((".", "")) + str(r.randrange(900))[: r.randrange(3)] + ".") for t in range(1500)]
    assert got(spark, rows) == naive(rows)


def test_reconstruction_against_every_edit_sequence():
    """All sequences of up to two insertions before each row and at the end."""
    r = random.Random(4)
    for _ in range(60):
        rows = [(r.choice(("user", "assistant", "system", "x")), r.choice(("", "dup", "bad", "ok"))) for _ in range(r.randrange(4))]
        faults = {"": conv.BLANK, "dup": conv.DUPLICATE, "bad": conv.TRUNCATED, "ok": conv.FINE}
        found = []
        for marks in product(*[[i + m for i in ("", "I", "II") for m in "KRD"] for _ in rows], ("", "I", "II")):
            states, cost, ok = {0}, 0, True
            for (role, text), mark in zip([*rows, ("", "end")], marks, strict=True):
                for m in mark:
                    cost += conv.COST[m] + (5 if text == "bad" and m in "KR" else 0)
                    ok &= not (m in "KR" and text in ("", "dup"))
                    if m == "K":
                        states = {1 for s in states if s == 0 and role[0] == "s"} | {conv.NEXT[s] for s in states if role[0] == "  ua"[conv.NEXT[s]]}
                    elif m != "D":
                        states = {conv.NEXT[s] for s in states}
            if ok and states & {0, 3}:
                found.append((cost, "".join(marks)))
        kinds = [conv.kind_of(role[0], faults[text]) for role, text in rows]
        end = conv.forward(conv.at_state(0), kinds)
        leave = conv.crossing(end, [c for c, _ in conv.FINISH])
        audit = "".join(conv.reconstruct(kinds, 0, leave)) + conv.FINISH[leave][1]
        assert (end[leave][0] + conv.FINISH[leave][0], audit) == min(found)


def test_matrices_compose():
    r = random.Random(9)
    kinds = [conv.kind_of(r.choice("sua"), r.randrange(4)) for _ in range(40)]
    vector = conv.at_state(0)
    for at in (0, 7, 19, 28):
        vector = conv.through(vector, conv.matrix(kinds[at : {0: 7, 7: 19, 19: 28, 28: 40}[at]]))
    whole = conv.forward(conv.at_state(0), kinds)
    assert [c for c, _ in vector] == [c for c, _ in whole]
    reachable = [s for s in range(4) if whole[s][0] < conv.NONE]
    assert sorted(reachable, key=lambda s: vector[s][1]) == sorted(reachable, key=lambda s: whole[s][1])


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = conv.op11_repair(spark, small)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == naive(rows)
    assert {k: v for k, v in df.dtypes if k not in ("conv_id", "audit", "repaired_sha256")} == dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint")
