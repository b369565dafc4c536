"""Licence scans: fuzzy search for short notices.

Each notice, a line of words, may be found with a bounded number of errors k. It is split into k + 1 pieces: a place
with at most k errors holds one piece without error (pigeonhole), so an exact search for all pieces gives every
candidate. Around each candidate the regex library matches the notice with at most k errors and gives its span, which begins and
ends between words.

Exact phrases (PHRASES) are counted beside: their labels always stay.

Null text is empty text: no words; an empty table gives an empty result. Of places of one label that overlap the one with the
fewest errors for its length stays, then the longer, then the first. Each input row gives one row, repeated rows too. Very long texts
are scanned whole, in memory proportional to their length. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import long_text, scan, table, words_of

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short notices, in words as the scan sees them, and their labels.
NOTICES = (
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl-2"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("eclipse public license version 2 0", "epl-2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "proprietary"),
)
#: One error for each so many characters of a notice, one at least.
CHARS_PER_ERROR = 16


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    n, k = len(notice), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeSearch:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> None:
        import ahocorasick
        import regex

        self.notices = []
        seeds = defaultdict(list)
        for t, (notice, label) in enumerate(notices):
            k = max(1, len(notice) // chars_per_error)
            self.notices.append(
                (
                    notice,
                    label,
                    k,
                    regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice, special_only=True, literal_spaces=True)}){{e<={k}}}(?![^ ])"),
                ),
            )
            for offset, piece in pieces(notice, k):
                seeds[piece].append((t, offset))
        self.longest = max(len(notice) + k for notice, _, k, _ in self.notices)
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, str, float]]:
        """(start, stop, errors, label, score) of notices in words joined by blanks. Places of one label don't overlap:
        fewest errors for their length first. A place with errors falls to another label's that has fewer at the place.

        Each candidate has a window of its own, which is wider than the notice by its errors and the blank after it only, so a
        better match nearby hides no other one."""
        windows = defaultdict(set)
        for last, (n, uses) in self.seeds.iter(text):
            for t, offset in uses:
                k, size = self.notices[t][2], len(self.notices[t][0])
                a = last + 1 - n - offset
                windows[t].add((max(0, a - k), min(len(text), a + size + k + 1)))
        found = set()
        for t, own in windows.items():
            notice, label, _, pattern = self.notices[t]
            for a, b in own:
                for m in pattern.finditer(text, a, b):
                    if text[m.end() : m.end() + 1] not in ("", " "):
                        continue  # the window ends within a word
                    errors = sum(m.fuzzy_counts)
                    found.add((m.start(), m.end(), errors, label, 1 - errors / len(notice)))
        kept: list = []
        taken: dict = defaultdict(lambda: bytearray(len(text) + 1))
        for x in sorted(found, key=lambda x: (-x[4], -(x[1] - x[0]), x[0], x[3])):
            if not any(taken[x[3]][x[0] : x[1]]):
                taken[x[3]][x[0] : x[1]] = b"\1" * (x[1] - x[0])
                kept.append(x)
        kept.sort()
        starts = [x[0] for x in kept]

        def explained(x: tuple) -> bool:
            near = kept[bisect_left(starts, x[0] - self.longest) : bisect_right(starts, x[0] + x[2])]
            return any(y[2] < x[2] and y[3] != x[3] and max(0, y[0] - x[0]) + max(0, x[1] - y[1]) <= x[2] for y in near)

        return [x for x in kept if not x[2] or not explained(x)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices for every row of docs.
    notices: label:first word:last word:errors of each fuzzy place, in order; places of different labels may overlap."""
    phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]

    def factory() -> Callable:
        notices = NoticeSearch()

        def work(doc_id: int | None, text: str | None) -> tuple:
            words = words_of(text)
            joined = b" " + b" ".join(words) + b" "
            starts, labels = [], set()
            for phrase, label in phrases:
                at = joined.find(phrase)
                while at >= 0:
                    starts.append(at)
                    labels.add(label)
                    at = joined.find(phrase, at + 1)
            first, last = ((joined.count(b" ", 0, min(starts)), joined.count(b" ", 0, max(starts))) if starts else (None, None))
            line = joined.decode("utf-8", "surrogatepass")
            fuzzy = notices.search(line)
            spans, at, n = [], 0, 0
            for a, b, errors, label, _ in fuzzy:
                n, at = n + line.count(" ", at, a), a
                begins = n - (line[a] != " ")
                spans.append(f"{label}:{begins}:{begins + line.count(' ', a + 1, b - 1)}:{errors}")
            score = 1.0 if starts else max((x[4] for x in fuzzy), default=0.0)
            return doc_id, len(words), len(starts), first, last, ",".join(sorted(labels)), ",".join(
                sorted(labels | {x[3] for x in fuzzy}),
            ), float(score), ",".join(spans)

        return work

    return scan(
        long_text(docs, id_col, text_col),
        (
            f"{id_col} bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
            f"score double, notices string"
        ),
        factory,
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op3_licenses": op3_licenses}
ORACLE_SQL: dict[str, str] = {}
