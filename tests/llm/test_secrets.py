from __future__ import annotations

import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import secrets

NAIVE = (
    (
        "assign",
        re.compile(
            r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        ),
        lambda m: len(m.group(2)) >= 12,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 16),
)


def naive(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(NAIVE) for m in p.finditer(text) if ok(m)]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


PARTS = st.sampled_from(
    [
        "token",
        "ToKen",
        "passwd",
        "api_key",
        "apikey",
        "secret",
        "=",
        " = ",
        ":",
        '"',
        "'",
        "AKIA",
        "AKIAAB12CD34EF56GH",
        "deadbeef",
        "0123456789abcdef",
        "abcdefgh1234",
        " ",
        "X",
        "ſecret",
        "toKen=",
        "é",
    ],
)


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_are_the_patterns(text):
    assert secrets.base_spans(text) == naive(text)


def test_random_strings_and_identifiers(make):
    texts = [
        (1, "key Zx9qT4vLm2KpR8wYb3NcJ7dH5sG1fA0e here"),
        (2, "commit d670460b4b4aece5915caf5c68d12f560a9fe3e4 and 123e4567-e89b-12d3-a456-426614174000"),
        (3, "internationalisation_of_configuration_files and Counterrevolutionaries"),
        (4, 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"'),
    ]
    got = {r.doc_id: r for r in secrets.find_secrets(make(texts)).collect()}
    assert got[1].spans == "random:4:36" and got[1].n_random == 1
    assert got[2].n_hex == 1 and got[2].n_random == 0  # a digest is a base span, the identifier none
    assert got[3].spans == "" and got[4].n_assign == got[4].n_hex == 1 and got[4].n_random == 0
    assert got[4].base_sha256 == hashlib.sha256(got[4].spans.encode()).hexdigest()


def test_words_joined_to_a_random_string_do_not_hide_it():
    lengths, r = secrets.token_lengths(secrets.vocabulary_path()), random.Random(3)
    made = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(20)) for _ in range(100)]
    for before, after in (
        ("", ""),
        ("connection-string=", ""),
        ("docs/articles/published/", ""),
        ("the/longest/path/of/all/the/documentation/articles/", "/published/version"),
        ("123e4567-e89b-12d3-a456-426614174000_", ""),
    ):
        hit = [any(a < len(before) + 20 and len(before) < b for _, a, b in secrets.random_spans(before + x + after, lengths)) for x in made]
        assert sum(hit) >= 98, (before, sum(hit))


def test_paths_numbers_and_identifiers_are_not_random():
    lengths = secrets.token_lengths(secrets.vocabulary_path())
    for text in (
        "docs/2024/01/15/publishing-articles-on-time",
        "123e4567-e89b-12d3-a456-426614174000",
        "id-123e4567-e89b-12d3-a456-426614174000",
        "connection-string=the_documentation_of_all",
        "path/to/commit/d670460b4b4aece5915caf5c68d12f560a9fe3e4/documentation/of/the/configuration",
    ):
        assert secrets.random_spans(text, lengths) == [], text


def test_odd_rows(odd, none):
    got = secrets.find_secrets(odd).collect()
    assert len(got) == 13 and sum(r.n_hex for r in got) == 2 and sum(r.n_assign + r.n_access for r in got) == 0
    assert secrets.find_secrets(none).count() == 0


ALPHABETS = {
    "mixed": string.ascii_letters + string.digits,
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "url": string.ascii_letters + string.digits + "-_",
    "hex-like": "0123456789abcdef",
}
PLAIN = (
    "internationalisation-of-the-configuration",
    "2024-01-15T10-20-30-report",
    "backup_2023-12-31_final_version",
    "src/main/resources/templates/index",
    "GetElementsByClassName",
    "THE_LONGEST_CONSTANT_NAME",
    "item-12-of-300-in-total-2024",
    "1234567890123456789012345",
    "einlichheitenverantwortung",
)


def test_recall_and_precision_of_planted_strings(make):
    """Through the query: nine of ten random strings at least, of each alphabet, and none of the plain ones."""
    r, rows, want = random.Random(8), [], {}
    for name, letters in ALPHABETS.items():
        for i in range(100):
            key = "".join(r.choice(letters) for _ in range(r.choice((24, 32, 39))))
            k = len(rows)
            rows.append((k, f"the value {key} was used on {r.choice(PLAIN)} today"))
            want[k] = (name, 10, 10 + len(key))
    found = dict.fromkeys(ALPHABETS, 0)
    wrong = 0
    for x in secrets.find_secrets(make(rows)).collect():
        name, a, b = want[x.doc_id]
        spans = [tuple(map(int, y.split(":")[1:])) for y in x.spans.split(",") if y]
        found[name] += any(min(b, d) - max(a, c) >= 0.8 * (b - a) for c, d in spans)
        wrong += sum(y.startswith("random") and int(y.split(":")[1]) >= b for y in x.spans.split(","))
    assert wrong == 0 and all(n >= 90 for n in found.values()), (found, wrong)
    assert found["mixed"] == found["hex-like"] == 100


def test_whole_query_base_is_brute_force(make):
    r = random.Random(12)
    parts = [
        "token",
        "passwd",
        "api_key",
        "=",
        ": ",
        '"',
        "AKIAAB12CD34EF56GH",
        "deadbeef",
        "0123456789abcdef",
        "abcdefgh1234",
        " ",
        "Zx9qT4vLm2KpR8wYb3NcJ7dH5sG1fA0e",
        "words here",
        "é",
    ]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(14)))) for i in range(300)] + [(300, None), (301, ""), (5, "again secret = abcdefgh1234")]
    got = sorted(secrets.find_secrets(make(rows)).collect(), key=lambda x: (x.doc_id, x.base_sha256))
    want = []
    for i, text in rows:
        base = naive(text or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(sum(k == kind for k, _, _ in base) for kind in secrets.KINDS), hashlib.sha256(written.encode()).hexdigest()))
    assert [(x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in got] == sorted(want, key=lambda w: (w[0], w[-1]))
    texts = {hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in naive(t or "")).encode()).hexdigest(): t for _, t in rows}
    for x in got:
        spans = [y for y in x.spans.split(",") if y]
        base = [f"{k}:{a}:{b}" for k, a, b in naive(texts[x.base_sha256] or "")]
        assert [y for y in spans if not y.startswith("random")] == base or len(texts) < len(rows)
        assert len(spans) == x.n_assign + x.n_access + x.n_hex + x.n_random
    assert any(x.n_random for x in got)
