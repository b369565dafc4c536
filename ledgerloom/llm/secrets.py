"""Secret scans by token efficiency.

Three base patterns give the assignments, access keys and long hexadecimal runs. Beyond them, every long run of
credential characters is split by a byte-level BPE vocabulary: text that the vocabulary knows takes few tokens, a random
string takes many, so few characters for each token give a random string away. What the ratio can't tell is excluded first: known
digests (hexadecimal runs of a usual length), UUIDs, time stamps, and runs without a letter. Words, names and paths are told
by their ratio. A run is tested as a whole, by what it has beside separators and numbers, then by its parts between
separators, then by its densest stretches, so that a path or name that is joined to a random string doesn't hide it.

Null text is empty text: no spans; an empty table gives an empty result. Ties: of stretches with the same gain the first one is
taken. Each input row gives one row, repeated rows too. Very long texts are scanned whole, in memory proportional to their
length. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import long_text, scan, sha256_hex, table

# The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
SEPARATORS = "=-_/+"
PART = re.compile(r"[A-Za-z0-9]+")
#: Words and numbers from this length on end a stretch; shorter ones may be chance within a random string.
WORD_LEAST = 4
#: Characters beside separators and numbers that a run needs to be tested as a whole.
CONTENT_LEAST = 12
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
STAMP = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}([-_/]?)[0-9]{2}\1[0-9]{2}(?:[T_-]?[0-9]{2}([-_]?)[0-9]{2}(?:\2[0-9]{2})?Z?)?(?![0-9])")
EXCLUDED = re.compile(f"{UUID.pattern}|{STAMP.pattern}")
#: Hexadecimal lengths of the usual digests: CRC-32 to SHA-512.
DIGEST_LENGTHS = frozenset((8, 16, 32, 40, 48, 56, 64, 96, 128))
ONLY_HEX = re.compile(r"[0-9a-fA-F]+")

#: A run with fewer characters for each token than this is random.
CHARS_PER_TOKEN = 2.0
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_lengths(path: str) -> Callable[[str], list[int]]:
    """The lengths of the tokens that the vocabulary at the path needs for an ASCII string."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: [len(t) for t in encoding.decode_tokens_bytes(encoding.encode_ordinary(text))]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind. A hexadecimal run of 16 characters or more is a whole match of the run
    pattern, since shorter runs are dropped; the same holds for access keys."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def identifier(run: str) -> bool:
    """Whether a run is a known digest, a UUID, or has no letter."""
    return bool(ONLY_HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run)) or not any(map(str.isalpha, run))


def densest(run: str, lengths: list[int], most: float, known_part: Callable[[str], bool] = identifier) -> list[tuple[int, int]]:
    """The stretches of LEAST characters or more with fewer than most characters a token, the best one first cut out and
    then what is left and right of it. Words, numbers and digests between separators end a stretch; the short ones
    among them, and separators, count for nothing."""
    gain = [0.0] * len(run)  # of the token that ends here
    wall = [-1] * (len(run) + 1)  # the last character before here that no stretch may have
    for m in PART.finditer(run):
        if known_part(m.group()):
            for i in range(m.start(), m.end()):
                wall[i + 1] = i if m.end() - m.start() >= WORD_LEAST else -1
    known = [False] * len(run)
    for m in PART.finditer(run):
        if known_part(m.group()):
            known[m.start() : m.end()] = [True] * (m.end() - m.start())
    ends, at = [0], 0
    for n in lengths:
        new = any(c.isalnum() and not k for c, k in zip(run[at : at + n], known[at : at + n], strict=True))
        at += n
        gain[at - 1] = most - n if new else min(0.0, most - n)
        ends.append(at)
    for i in range(1, len(wall)):
        wall[i] = max(wall[i], wall[i - 1])
    total = [0.0]
    for e in ends[1:]:
        total.append(total[-1] + gain[e - 1])
    found, todo = [], [(0, len(ends) - 1)]
    while todo:
        lo, hi = todo.pop()
        best, span, low, j = 0.0, None, None, lo
        for i in range(lo + 1, hi + 1):
            if wall[ends[i]] >= ends[i - 1]:  # no stretch has this token
                low, j = None, i
                continue
            while j < i and ends[i] - ends[j] >= LEAST:
                if low is None or total[j] < total[low]:
                    low = j
                j += 1
            if low is not None and total[i] - total[low] > best:
                best, span = total[i] - total[low], (low, i)
        if span:
            found.append((ends[span[0]], ends[span[1]]))
            todo += [(lo, span[0]), (span[1], hi)]
    return sorted(found)


def random_spans(text: str, lengths: Callable[[str], list[int]], most: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    out = []

    def ratio(parts: list[str]) -> float:
        return sum(map(len, parts)) / max(1, sum(len(lengths(p)) for p in parts))

    def known_part(part: str) -> bool:
        """A digest, a number, or a word in small or capital letters, perhaps with a capital in front."""
        return identifier(part) or part.isalpha() and part[1:] in (part[1:].lower(), part[1:].upper()) and ratio([part]) >= most

    def is_random(run: str) -> bool:
        content = [m.group() for m in PART.finditer(run) if not m.group().isdigit()]
        return len(run) >= LEAST and not identifier(run) and sum(map(len, content)) >= CONTENT_LEAST and ratio(content) < most

    def test(start: int, stop: int) -> None:
        run = text[start:stop]
        if is_random(run.strip(SEPARATORS)):
            out.append(("random", start, stop))
            return
        parts = [(start + m.start(), start + m.end()) for m in PART.finditer(run) if is_random(m.group())]
        out.extend(("random", a, b) for a, b in parts)
        at = start
        for a, b in [*parts, (stop, stop)]:
            rest = text[at:a]
            if len(rest) >= LEAST and not identifier(rest.strip(SEPARATORS)):
                out.extend(("random", at + x, at + y) for x, y in densest(rest, lengths(rest), most, known_part))
            at = b

    for m in CANDIDATE.finditer(text):
        at = m.start()
        for u in EXCLUDED.finditer(text, m.start(), m.end()):
            if u.start() - at >= LEAST:
                test(at, u.start())
            at = u.end()
        if m.end() - at >= LEAST:
            test(at, m.end())
    return sorted(out, key=lambda s: s[1:])


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    chars_per_token: float = CHARS_PER_TOKEN,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs."""

    def factory() -> Callable:
        made: list[Callable[[str], list[int]]] = []

        def lengths(run: str) -> list[int]:  # the vocabulary is read when the first candidate comes
            if not made:
                made.append(token_lengths(vocabulary or vocabulary_path()))
            return made[0](run)

        def work(doc_id: int | None, text: str | None) -> tuple:
            text = text or ""
            base = base_spans(text)
            count = [sum(s[0] == k for s in base) for k in KINDS]
            added = [s for s in random_spans(text, lengths, chars_per_token) if not any(a < s[2] and s[1] < b for _, a, b in base)]
            order = {k: i for i, k in enumerate((*KINDS, "random"))}
            write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]])))
            return doc_id, *count, sha256_hex(write(base)), write(base + added), len(added)

        return work

    return scan(
        long_text(docs, id_col, text_col),
        f"{id_col} bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint",
        factory,
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLE_SQL: dict[str, str] = {}
