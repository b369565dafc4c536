"""Repair of damaged conversations by Hirschberg's divide and conquer.

A conversation is repaired to role initials s?(ua)+ (or nothing) by the cheapest edits: keep a row, give it another role, delete it,
or insert an empty turn. The edits' path runs through four states: at the start, after the system's turn, after a user's, after
an assistant's. For a stretch of rows a forward pass gives, for each state, the least cost of reaching it and the rank of its
least audit among the states; a backward pass gives the least cost from each state on. Both meet in the middle: of the states
whose sum is least, the one of the least audit is the crossing, and both halves are solved alone between known states. So the path is
rebuilt in space linear in the rows. Insertions belong to the row that follows, so that audits up to a row never are
beginnings of one another, and ranks decide every tie.

In Spark, rows are sorted into ranges of (conversation, turn, role, text) and cut into segments of a bounded number of rows and
bytes. A segment's 4 x 4 matrix of costs and ranks is all that others need of it. A conversation within one segment is
repaired there. One that spans several, as one that holds a third of all rows, is streamed by its matrices alone, forward and then
backward, which gives the crossing states at the segments' borders; then the segments are rebuilt each in a task of its own. What is joined of
such a conversation at the end is its result: the audit is one value, and its digest reads the repaired text in order, both with constant
memory beside that value.

Null roles and texts are one space, and so are nulls in the key of the damage. Rows are ordered by turn, nulls first, then
role and text; rows that are alike in all of them count as copies, which are combined before the shuffle: all but the first are duplicates. A
null conv_id is a conversation of its own. Empty tables give empty results. Texts of any length are read whole. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scan_many, stage_written, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: A row's first fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after the system, after a user, after an assistant. What a user's or assistant's turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NONE = 1 << 60
#: A segment's rows and bytes of text at most (and one row more).
SEGMENT_ROWS, SEGMENT_BYTES = 512, 4 << 20


def _suffixes(initial: str, fault: int) -> list[list[tuple[int, str] | None]]:
    """For each state before and after a row: the least (cost, edits) that lead there, the row's own edit last."""
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        state, inserted = before, ""
        for _ in range(3):
            ends = [(state, COST[DELETE], DELETE)]
            if fault not in (BLANK, DUPLICATE):
                after = NEXT[state]
                ends.append((after, COST[REROLE] + extra, REROLE))
                if initial == ("a" if after == ASSISTANT else "u"):
                    ends.append((after, COST[KEEP] + extra, KEEP))
                if initial == "s" and state == START:
                    ends.append((SYSTEM, COST[KEEP] + extra, KEEP))
            for after, cost, edit in ends:
                found = (cost + COST[INSERT] * len(inserted), inserted + edit)
                if table[before][after] is None or found < table[before][after]:
                    table[before][after] = found
            state, inserted = NEXT[state], inserted + INSERT
    return table


_KINDS = {(initial, fault): _suffixes(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}
#: The edits that end a conversation in each state.
FINISH = ((0, ""), (2 * COST[INSERT], INSERT * 2), (COST[INSERT], INSERT), (0, ""))


def kind_of(initial: str, fault: int) -> list:
    return _KINDS[initial if initial in ("s", "u", "a") else "", fault]


def forward(vector: list[tuple[int, int]], kinds: list) -> list[tuple[int, int]]:
    """(cost, rank of the least audit among the states) for each state after the rows, from such a vector before them."""
    for kind in kinds:
        best = [(NONE, 0, "")] * 4
        for before, (cost, rank) in enumerate(vector):
            if cost < NONE:
                for after, step in enumerate(kind[before]):
                    if step is not None and (found := (cost + step[0], rank, step[1])) < best[after]:
                        best[after] = found
        order = sorted(range(4), key=lambda s: best[s][1:])
        ranks = [0] * 4
        for at, s in enumerate(order):
            ranks[s] = at
        vector = [(best[s][0], ranks[s]) for s in range(4)]
    return vector


def backward(costs: list[int], kinds: list) -> list[int]:
    """The least cost from each state before the rows, from the costs after them."""
    for kind in reversed(kinds):
        costs = [min((step[0] + costs[after] for after, step in enumerate(row) if step is not None), default=NONE) for row in kind]
    return costs


def at_state(state: int) -> list[tuple[int, int]]:
    return [(0 if s == state else NONE, s) for s in range(4)]


def crossing(before: list[tuple[int, int]], after: list[int]) -> int:
    """The state of the least sum of both sides' costs, by least audit."""
    return min(range(4), key=lambda s: (min(before[s][0] + after[s], NONE), before[s][1]))


def reconstruct(kinds: list, entry: int, leave: int) -> list[str]:
    """The edits of each row on the best path between two states."""
    out, stack = [], [(0, len(kinds), entry, leave)]
    while stack:
        low, high, a, b = stack.pop()
        if high - low == 1:
            out.append(kinds[low][a][b][1])
        elif high > low:
            middle = (low + high) // 2
            ends = [0 if s == b else NONE for s in range(4)]
            met = crossing(forward(at_state(a), kinds[low:middle]), backward(ends, kinds[middle:high]))
            stack.append((middle, high, met, b))
            stack.append((low, middle, a, met))
    return out


def matrix(kinds: list) -> list[tuple[int, int]]:
    """For each state before the rows and each after them: the least cost, and the rank of its audit in the row."""
    return [x for s in range(4) for x in forward(at_state(s), kinds)]


def through(vector: list[tuple[int, int]], cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forward vector carried over a whole matrix."""
    best = [(NONE, 0, 0)] * 4
    for a, (cost, rank) in enumerate(vector):
        for b in range(4):
            more, inner = cells[4 * a + b]
            if cost < NONE and more < NONE:
                best[b] = min(best[b], (cost + more, rank, inner))
    order = sorted(range(4), key=lambda s: best[s][1:])
    return [(best[s][0], order.index(s)) for s in range(4)]


def repaired(rows: list[tuple[str, str]], edits: list[str], state: int) -> tuple[list[str], int]:
    """The turns, as role:text, that edits make of (role, text), and the state after them."""
    out = []
    for (role, text), marks in zip(rows, edits, strict=True):
        for mark in marks:
            if mark == DELETE:
                continue
            own = "assistant" if NEXT[state] == ASSISTANT else "user"
            if mark == KEEP:
                out.append(f"{role}:{text}")
                state = SYSTEM if role[:1] == "s" else NEXT[state]
            else:
                out.append(f"{own}:{text if mark == REROLE else ''}")
                state = NEXT[state]
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after damage, copies counted."""
    turn = conversations["turn"].cast("long")
    rows = conversations.select(
        conversations["conv_id"].alias("conv_id"),
        turn.alias("turn"),
        F.coalesce(conversations["role"], F.lit(" ")).alias("role"),
        F.coalesce(conversations["text"], F.lit(" ")).alias("text"),
        (
            F.crc32(
                F.concat(
                    F.coalesce(conversations["conv_id"].cast("string"), F.lit(" ")),
                    F.lit(":"),
                    F.coalesce(turn.cast("string"), F.lit(" ")),
                ),
            )
            % 20
        ).alias("harm"),
    )
    return (
        rows.where("harm <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("n"))
    )


def faulty(rows: DataFrame) -> DataFrame:
    """The rows with their first copy's fault. rows: conv_id, turn, role, text, n."""
    blanks = "\\x20\\x09-\\x0D"
    earliest = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    digest = F.sha2("text", 256)
    rows = rows.withColumn("digest", digest)
    seen = rows.groupBy("conv_id", "role", "digest").agg(F.min(earliest).alias("first"), F.max(earliest).alias("last"))
    seen = seen.where("first <> last").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault: Column = (
        F.when(~F.col("text").rlike(f"[^{blanks}]"), BLANK)
        .when(F.coalesce(earliest > F.col("first"), F.lit(False)), DUPLICATE)
        .when(~F.col("text").rlike(f"[.!?][{blanks}]*\\z"), TRUNCATED)
        .otherwise(FINE)
    )
    marked = rows.join(seen, same, "left").withColumn("fault", fault)
    return marked.select("conv_id", "turn", "role", "text", "n", "fault")


SEGMENT = (
    "conv string, segment bigint, turn_low bigint, turn_high bigint, turns bigint, n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint, "
    "first_role string, last_role string, extra bigint, costs array<bigint>, ranks array<bigint>, "
    "roles array<string>, texts array<string>, faults array<bigint>, copies array<bigint>"
)


def segments(rows: DataFrame) -> DataFrame:
    """Runs of one conversation's rows in order, of bounded size, with what others need of them. conv is the id as text."""
    ordered = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    keyed = rows.withColumn("conv", F.col("conv_id").cast("string")).select("conv", "turn", "role", "text", "n", "fault")
    ranged = keyed.repartitionByRange(*ordered).sortWithinPartitions(*ordered)

    def factory() -> Callable:
        def work(given: Iterator[tuple]) -> Iterator[list]:
            number = TaskContext.get().partitionId() << 33
            held: list[tuple] = []
            size = 0

            def made() -> list:
                nonlocal number
                turns = [r[1] for r in held if r[1] is not None]
                initials = [r[2][:1] for r in held]
                pairs = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
                kinds = [kind_of(i, r[5]) for i, r in zip(initials, held, strict=True)]
                cells = matrix(kinds)
                copies = [r[4] for r in held]
                values = (
                    held[0][0],
                    number,
                    min(turns, default=None),
                    max(turns, default=None),
                    len(set(turns)),
                    sum(r[4] for r in held if r[5] == BLANK),
                    sum(r[4] if r[5] == DUPLICATE else r[4] - 1 for r in held if r[5] != BLANK),
                    sum(r[5] == TRUNCATED for r in held),
                    pairs + sum(c - 1 for c in copies),
                    initials[0],
                    initials[-1],
                    COST[DELETE] * sum(c - 1 for c in copies),
                    [c for c, _ in cells],
                    [k for _, k in cells],
                    [r[2] for r in held],
                    [r[3] for r in held],
                    [r[5] for r in held],
                    copies,
                )
                number += 1
                return [[v] for v in values]

            for row in given:
                if held and (row[0] != held[0][0] or len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                    yield made()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
            if held:
                yield made()

        return work

    return scan_many(ranged, SEGMENT, factory)


HEAD = ["conv", "segment", "costs", "ranks"]
BODY = ["conv", "segment", "turn_low", "turn_high", "turns", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "first_role", "last_role", "extra", "costs", "ranks", "roles", "texts", "faults", "copies"]
RESULT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def reached(heads: DataFrame) -> DataFrame:
    """The forward vector before each segment, streamed in order. heads: conv, segment, costs, ranks."""

    def factory() -> Callable:
        def work(given: Iterator[tuple]) -> Iterator[list]:
            conv, vector, begun = None, at_state(START), False
            for own, segment, costs, ranks in given:
                if not begun or own != conv:
                    conv, vector, begun = own, at_state(START), True
                yield [[own], [segment], [costs], [ranks], [[c for c, _ in vector]], [[k for _, k in vector]]]
                vector = through(vector, list(zip(costs, ranks, strict=True)))

        return work

    schema = "conv string, segment bigint, costs array<bigint>, ranks array<bigint>, before_costs array<bigint>, before_ranks array<bigint>"
    return scan_many(heads.select(*HEAD).repartition("conv").sortWithinPartitions("conv", "segment"), schema, factory)


def crossings(vectors: DataFrame) -> DataFrame:
    """segment, entry, leave, last: the states at each segment's borders, streamed backward. vectors: as reached gives them."""

    def factory() -> Callable:
        def work(given: Iterator[tuple]) -> Iterator[list]:
            conv, begun, after, leave = None, False, [], START
            for own, segment, costs, ranks, before_costs, before_ranks in given:
                cells = list(zip(costs, ranks, strict=True))
                before = list(zip(before_costs, before_ranks, strict=True))
                last = not begun or own != conv
                if last:
                    conv, begun, after = own, True, [c for c, _ in FINISH]
                    leave = crossing(through(before, cells), after)
                after = [min(min(cells[4 * a + b][0] + after[b] for b in range(4)), NONE) for a in range(4)]
                entry = crossing(before, after)
                yield [[segment], [entry], [leave], [last]]
                leave = entry

        return work

    ordered = vectors.repartition("conv").sortWithinPartitions("conv", F.desc("segment"))
    return scan_many(ordered, "its bigint, entry bigint, leave bigint, last boolean", factory)


def _part(row: tuple) -> tuple:
    """A segment's row with its states as one that finish joins: cost, audit and repaired turns in place of the rows."""
    conv, segment, low, high, turns, blank, duplicate, truncated, illegal, first, end, extra, costs, _, roles, texts, faults, copies, entry, leave, last = row
    kinds = [kind_of(role[:1], fault) for role, fault in zip(roles, faults, strict=True)]
    edits = reconstruct(kinds, entry, leave)
    said, state = repaired(list(zip(roles, texts, strict=True)), edits, entry)
    audit = "".join(e + DELETE * (n - 1) for e, n in zip(edits, copies, strict=True))
    cost = costs[4 * entry + leave] + extra
    if last:
        cost += FINISH[leave][0]
        audit += FINISH[leave][1]
        for _ in FINISH[leave][1]:
            said.append("assistant:" if NEXT[state] == ASSISTANT else "user:")
            state = NEXT[state]
    return conv, segment, low, high, turns, blank, duplicate, truncated, illegal, first, end, cost, audit, "\n".join(said), len(said)


def _finished(parts: Iterator[tuple]) -> Iterator[tuple]:
    """One result for each conversation of parts in order; a part's text is dropped once it is digested."""
    held = None
    for conv, _, low, high, turns, blank, duplicate, truncated, illegal, first, end, cost, audit, said, n_said in parts:
        if held is None or held["conv"] != conv:
            if held is not None:
                yield _result(held)
            held = {"conv": conv, "low": None, "high": None, "turns": 0, "sums": [0] * 5, "end": None, "audit": [], "sha": hashlib.sha256(), "said": 0}
        if low is not None:
            held["turns"] += turns - (held["high"] == low)
            held["low"], held["high"] = low if held["low"] is None else held["low"], high
        border = held["end"] is not None and held["end"] + first not in ("su", "ua", "au")
        held["sums"] = [a + b for a, b in zip(held["sums"], (blank, duplicate, truncated, illegal + border, cost), strict=True)]
        held["end"] = end
        held["audit"].append(audit)
        if n_said:
            held["sha"].update((("\n" if held["said"] else "") + said).encode("utf-8", "surrogatepass"))
            held["said"] += n_said
    if held is not None:
        yield _result(held)


def _result(held: dict) -> tuple:
    gaps = 0 if held["low"] is None else held["high"] - held["low"] + 1 - held["turns"]
    return held["conv"], gaps, *held["sums"], "".join(held["audit"]), held["sha"].hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of conversations, after
    damage. Segments and forward vectors are written to the shared folder."""
    cut = stage_written(segments(faulty(damaged(conversations))), "segments")
    spanning = cut.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("its"))
    here = F.col("conv").eqNullSafe(F.col("its"))

    def alone_factory() -> Callable:
        def work(given: Iterator[tuple]) -> Iterator[list]:
            for row in given:
                end = through(at_state(START), list(zip(row[12], row[13], strict=True)))
                leave = crossing(end, [c for c, _ in FINISH])
                yield [[v] for v in next(_finished(iter([_part((*row, START, leave, True))])))]

        return work

    alone = scan_many(cut.join(spanning, here, "left_anti").select(*BODY), RESULT, alone_factory)
    several = cut.join(spanning, here, "left_semi")
    states = crossings(stage_written(reached(several), "forward"))

    def part_factory() -> Callable:
        return lambda given: ([[v] for v in _part(row)] for row in given)

    parts = scan_many(
        several.join(states, F.col("segment") == F.col("its")).select(*BODY, "entry", "leave", "last"),
        "conv string, segment bigint, turn_low bigint, turn_high bigint, turns bigint, n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint, "
        "first_role string, last_role string, cost bigint, audit string, said string, n_said bigint",
        part_factory,
    )

    def joined_factory() -> Callable:
        return lambda given: ([[v] for v in row] for row in _finished(given))

    joined = scan_many(parts.repartition("conv").sortWithinPartitions("conv", "segment"), RESULT, joined_factory)
    ids = conversations.select(conversations["conv_id"].alias("conv_id")).distinct()
    rows = ids.join(alone.unionByName(joined), ids["conv_id"].cast("string").eqNullSafe(F.col("conv")), "left").drop("conv")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_repair": op11_repair}

# The forward pass alone, with whole audits and texts in place of ranks.
ORACLE_SQL: dict[str, str] = {}
