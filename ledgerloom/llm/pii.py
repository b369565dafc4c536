"""Personal data by a skip-chain conditional random field.

Nodes are the tokens (between white space) that hold a digit or an @; every other token is certainly ordinary text and
cuts the chain. Skip edges join a token to the next one in the document with the same characters, or that ends a number with
the same last digits in another format, so a value that is recognised in one place is recognised where its format alone doesn't
tell. Chain edges join neighbours that something else shows to be one value: parts of a base span, parts of a number whose digits
repeat those at the other end of a skip edge, or what follows a word that announces a phone or card. Numbers that merely stand side by side, as
in tables, dates and ranges of years, don't support each other, and tokens that repeat each other without more are as
ready to agree on being ordinary as on a kind. Only what edges join to a base span or to a cue may get a label. Loopy sum-product messages run over all documents of a slice at once; beliefs give the labels.

The base patterns give the kinds email, ip, card and phone; their spans always stay and hold their tokens' labels. The
field adds spans over tokens that no base span covers; neighbours of one label are one span as long as it has no more digits than
the kind may have. The weights are fitted by penalised pseudo-likelihood, around fixed starting weights, to base labels in a
bounded sample of documents (TRAIN_DOCS). A base span always shows in its tokens' format, so each one counts once more as
a repetition with its format hidden (bare digits, or nothing): what then tells the label is the edge to the span, and so the skip
edges' weights are learned. A token without a base label that has a skip edge to a labelled one may be either and counts for
nothing.

Null text is empty text; an empty table gives an empty result. Ties of beliefs go to the kind that is listed first; a belief of
exactly LEAST_BELIEF is enough. Each input row gives one row, repeated rows too. Very long texts are handled whole, in memory
proportional to their tokens with a digit or an @. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, hash_sample, long_text, scan_many, sha256_hex, table, text_column

# The kinds in their order and their patterns. Possessive repeats and look-behinds only save retries.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents, about, that the weights are fitted on.
TRAIN_DOCS = 4000
ROUNDS = 8
#: Tokens are the same from so many characters on; numbers are similar if so many last digits agree, of runs of neighbours.
SAME_LEAST, TAIL, RUN = 5, 7, 24
#: Digits that an added span may have, if it covers several tokens.
MOST_DIGITS = {"email": 0, "ip": 0, "card": 19, "phone": 15}
#: Belief from which a token gets a label.
LEAST_BELIEF = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap. The local part before an @ is a run of characters that holds no @, so each @
    has one candidate; this takes linear time on long runs without @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        elif start < at:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- the field

LABELS = ("other", *KINDS)
L = len(LABELS)
FEATURES = (
    "bias",
    "at",
    "letters",
    "hex",
    "three_dots",
    "octets",
    "plus",
    "parenthesis",
    "dash",
    "luhn",
    "d1",
    "d4",
    "d7",
    "d9",
    "d13",
    "d20",
    "cue_email",
    "cue_ip",
    "cue_card",
    "cue_phone",
    "long",
)
INDEX = {name: i for i, name in enumerate(FEATURES)}
# Words that announce a kind, in four languages.
CUES = {
    "cue_email": ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt", "contacto"),
    "cue_ip": ("ip", "host", "server", "address", "adresse", "dirección"),
    "cue_card": ("card", "visa", "mastercard", "karte", "tarjeta", "carte"),
    "cue_phone": ("phone", "tel", "tel.", "telephone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"),
}
CUE_OF = {word: cue for cue, words in CUES.items() for word in words}
#: Cues of values that may take several tokens.
CUE_CARD = INDEX["cue_card"]
ANNOUNCING = frozenset((CUE_CARD, INDEX["cue_phone"]))
ANY_CUE = frozenset(INDEX[cue] for cue in CUES)
SPOT = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
EDGE = "\"'`()[]{}<>|,;:!?*#$%&=."


def starting_weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights before fitting, and all there is if the sample holds no token: (features x labels, chain, skip)."""
    w = np.zeros((len(FEATURES), L))
    w[INDEX["bias"], 0] = 3.0
    for name, label, value in (
        ("at", 1, 2.0),
        ("octets", 2, 4.0),
        ("luhn", 3, 2.5),
        ("d13", 3, 1.5),
        ("plus", 4, 1.5),
        ("parenthesis", 4, 1.0),
        ("dash", 4, 0.5),
        ("d9", 4, 0.5),
        ("cue_email", 1, 1.0),
        ("cue_ip", 2, 1.0),
        ("cue_card", 3, 1.0),
        ("cue_phone", 4, 1.5),
        ("letters", 0, 1.0),
        ("hex", 0, 2.0),
        ("d1", 0, 2.0),
        ("d20", 0, 2.0),
        ("long", 0, 1.0),
    ):
        w[INDEX[name], label] += value
    chain, skip = np.zeros((L, L)), np.zeros((L, L))
    chain[3, 3] = chain[4, 4] = 2.0  # parts of one value
    skip[np.arange(1, L), np.arange(1, L)] = 4.0
    return w, chain, skip


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Spans between white space that hold a digit or an @, without marks around them."""
    out, at = [], 0
    while m := SPOT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = m2.start() if (m2 := SPACE.search(text, m.end())) else len(text)
        at = stop
        inner = text[start:stop]
        start += len(inner) - len(inner.lstrip(EDGE.replace("(", "")))
        stop -= len(inner) - len(inner.rstrip(EDGE.replace(")", "")))
        if stop > start:
            out.append((start, stop))
    return out


def features_of(text: str, start: int, stop: int, before: str) -> list[int]:
    token = text[start:stop]
    digits = re.sub(r"[^0-9]", "", token)
    letters = any(c.isalpha() for c in token)
    n = len(digits)
    names = ["bias", "d1" if n < 4 else "d4" if n < 7 else "d7" if n < 9 else "d9" if n < 13 else "d13" if n < 20 else "d20"]
    names += ["at"] * ("@" in token) + ["letters"] * letters + ["hex"] * (
        letters and n > 0 and len(token) >= 16 and re.fullmatch(r"[0-9a-fA-F]+", token) is not None
    )
    if token.count(".") == 3:
        names.append("three_dots")
        parts = token.split(".")
        if all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
            names.append("octets")
    names += ["plus"] * ("+" in token) + ["parenthesis"] * ("(" in token or ")" in token) + ["dash"] * ("-" in token) + ["luhn"] * (
        13 <= n <= 19 and not letters and luhn(digits)
    ) + ["long"] * (len(token) > 40)
    if cue := CUE_OF.get(before.strip(EDGE).lower()):
        names.append(cue)
    return [INDEX[x] for x in names]


def keys_of(token: str, run: str) -> list[tuple[str, str]]:
    """What makes two tokens the same or similar: their characters, or the last digits of a long number, in whatever
    format, that ends with them. run: all digits of the neighbouring tokens up to this one."""
    out = [("same", token.lower())] if len(token) >= SAME_LEAST else []
    if len(run) >= TAIL:
        out.append(("tail", run[-TAIL:]))
    return out


class Graph:
    """The field of some documents. Node arrays: document, start, stop, features, base label or -1; edge arrays: from, to."""

    def __init__(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> None:
        self.doc, self.start, self.stop, self.feats, self.base = [], [], [], [], []
        self.chain, self.skip, self.alike = [], [], []  # alike: skip edges of values that nothing else shows
        self.shown: set[int] = set()  # what may get a label: see _shown
        for d, text in enumerate(texts):
            last: dict = {}
            first_node, skips = len(self.doc), []
            near: set[int] = set()  # nodes with a neighbour before them
            parts: set[tuple[int, int]] = set()  # chain edges within one value
            digits_of: dict[int, str] = {}
            announced = 0  # digits that a cue may still cover
            spans = sorted(((a, b, 1 + KINDS.index(k)) for k, a, b in base[d]))
            first, end, run = 0, -1, ""
            for start, stop in tokens_of(text):
                i = len(self.doc)
                gap = text[end:start] if end >= 0 else None
                before = text[max(0, start - 24) : start].split()
                self.doc.append(d)
                self.start.append(start)
                self.stop.append(stop)
                self.feats.append(features_of(text, start, stop, before[-1] if before else ""))
                while first < len(spans) and spans[first][1] <= start:
                    first += 1
                self.base.append(next((k for a, b, k in spans[first : first + 4] if a < stop and start < b), -1))
                token = text[start:stop]
                digits = re.sub(r"[^0-9]", "", token)
                digits_of[i] = digits
                if gap is not None and len(gap) <= 3 and not gap.strip(EDGE + " \t\n"):
                    near.add(i)
                    run = (run + digits)[-RUN:]
                    covered = 0 < len(digits) <= announced
                    if covered or self.base[i] > 0 and self.base[i - 1] == self.base[i]:
                        parts.add((i - 1, i))
                    announced = announced - len(digits) if covered else 0
                else:
                    run = digits[-RUN:]
                    announced = 0
                if not ANNOUNCING.isdisjoint(self.feats[i]):
                    announced = max(0, MOST_DIGITS["card" if CUE_CARD in self.feats[i] else "phone"] - len(digits))
                for key in keys_of(token, run):
                    if key in last:
                        j, other = last[key]
                        if not skips or skips[-1] != (j, i):
                            skips.append((j, i))
                        if key[0] == "tail":
                            alike = len(os.path.commonprefix([run[::-1], other[::-1]]))
                            for at in (i, j):  # back over the tokens that the digits in common cover whole
                                n = len(digits_of[at])
                                while at in near and digits_of[at - 1] and n + len(digits_of[at - 1]) <= alike:
                                    parts.add((at - 1, at))
                                    at -= 1
                                    n += len(digits_of[at])
                    last[key] = i, run
                end = stop
            self.chain += sorted(parts)
            shown = self._shown(first_node, [*skips, *parts])
            self.shown |= shown
            for pair in skips:
                (self.skip if pair[0] in shown else self.alike).append(pair)

    def _shown(self, first: int, edges: list[tuple[int, int]]) -> set[int]:
        """Nodes from the first one on that have a base label or a cue, or that edges join to such a node."""
        around: dict[int, list[int]] = {}
        for i, j in edges:
            around.setdefault(i, []).append(j)
            around.setdefault(j, []).append(i)
        todo = [i for i in range(first, len(self.doc)) if self.base[i] > 0 or not ANY_CUE.isdisjoint(self.feats[i])]
        shown = set(todo)
        while todo:
            for j in around.get(todo.pop(), ()):
                if j not in shown:
                    shown.add(j)
                    todo.append(j)
        return shown

    def unary(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.doc), L))
        if self.doc:
            at = np.repeat(np.arange(len(self.doc)), [len(f) for f in self.feats])
            np.add.at(out, at, w[np.concatenate([np.asarray(f) for f in self.feats])])
        held = np.asarray(self.base) if self.base else np.zeros(0, int)
        out[held > 0] = -30.0
        out[held > 0, held[held > 0]] = 0.0
        return out


def beliefs(unary: np.ndarray, edges: list[tuple[list, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy sum-product. edges: pairs of (list of (i, j), log potentials by labels of i and j)."""
    live = [(np.asarray(pairs), psi) for pairs, psi in edges if pairs]
    right = [np.zeros((len(p), L)) for p, _ in live]
    left = [np.zeros((len(p), L)) for p, _ in live]

    def total() -> np.ndarray:
        out = unary.copy()
        for (p, _), r, b in zip(live, right, left, strict=True):
            np.add.at(out, p[:, 1], r)
            np.add.at(out, p[:, 0], b)
        return out

    def passed(x: np.ndarray, psi: np.ndarray) -> np.ndarray:
        y = x[:, :, None] + psi[None]
        top = y.max(axis=1)
        out = top + np.log(np.exp(y - top[:, None, :]).sum(axis=1))
        return out - out.max(axis=1, keepdims=True)

    for _ in range(rounds if live else 0):
        b = total()
        new_right = [passed(b[p[:, 0]] - lf, psi) for (p, psi), lf in zip(live, left, strict=True)]
        new_left = [passed(b[p[:, 1]] - rt, psi.T) for (p, psi), rt in zip(live, right, strict=True)]
        right = [0.5 * a + 0.5 * n for a, n in zip(right, new_right, strict=True)]
        left = [0.5 * a + 0.5 * n for a, n in zip(left, new_left, strict=True)]
    b = total()
    b = np.exp(b - b.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def spans_of(texts: list[str | None], model: Model) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    g = Graph(texts, base)
    w, chain, skip = model
    added: list[list] = [[] for _ in texts]
    if g.doc:
        p = beliefs(g.unary(w), [(g.chain, chain), (g.skip, skip), (g.alike, np.eye(L) * skip.max())])
        label = np.where(p[:, 1:].max(axis=1) >= LEAST_BELIEF, 1 + p[:, 1:].argmax(axis=1), 0)
        linked = set(g.chain)
        n_digits = lambda d, a, b: sum(c.isdigit() for c in texts[d][a:b])
        for i, k in enumerate(label):
            if not k or g.base[i] > 0 or i not in g.shown:
                continue
            own = added[g.doc[i]]
            joins = own and (i - 1, i) in linked and label[i - 1] == k and g.base[i - 1] <= 0
            if joins and n_digits(g.doc[i], own[-1][1], g.stop[i]) <= MOST_DIGITS[KINDS[k - 1]]:
                own[-1] = (own[-1][0], own[-1][1], g.stop[i])
            else:
                own.append((KINDS[k - 1], g.start[i], g.stop[i]))
    return list(zip(base, added, strict=True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Weights from base labels in about train_docs documents. Equal cases are counted in Spark, so what comes to the
    driver is the number of different cases in the sample."""
    w0, chain0, skip0 = starting_weights()
    texts = long_text(docs, id_col, text_col)
    sample = hash_sample(texts, id_col, texts.count(), train_docs)

    def factory() -> Callable:
        def work(rows: Iterator[tuple]) -> Iterator[list]:
            held: list[str] = []

            def cases(batch: list[str]) -> list:
                base = [base_spans(t) for t in batch]
                g = Graph(batch, base)
                y = [max(0, b) for b in g.base]
                unclear = {i for pair in (*g.skip, *g.alike) for i, j in (pair, pair[::-1]) if not y[i] and y[j]}
                near = [[[0] * L, [0] * L] for _ in y]
                for kind, pairs in ((0, g.chain), (1, g.skip), (1, g.alike)):
                    for i, j in pairs:
                        for a, b in ((i, j), (j, i)):
                            if b not in unclear:
                                near[a][kind][y[b]] = min(3, near[a][kind][y[b]] + 1)
                out = [(f, c, s, k) for i, (f, (c, s), k) in enumerate(zip(g.feats, near, y, strict=True)) if i not in unclear]
                for text, spans in zip(batch, base, strict=True):
                    for kind, a, b in spans:
                        pieces = [x for x in re.findall(r"[0-9]+", text[a:b])] if kind in ("card", "phone") else []
                        if len(pieces) > 1:  # the parts of a repetition with bare digits: neighbours of one label, the skip edge at the last
                            k = 1 + KINDS.index(kind)
                            for i, piece in enumerate(pieces):
                                beside, skipped = [0] * L, [0] * L
                                beside[k] = (i > 0) + (i < len(pieces) - 1)
                                skipped[k] = int(i == len(pieces) - 1)
                                out.append((features_of(piece, 0, len(piece), ""), beside, skipped, k))
                        bare, k = re.sub(r"[^0-9]", "", text[a:b]) if kind in ("card", "phone") else "", 1 + KINDS.index(kind)
                        seen = features_of(bare, 0, len(bare), "") if bare else [INDEX["bias"]]
                        out.append((seen, [0] * L, [int(x == k) for x in range(L)], k))
                return [[f"{sorted(set(f))}|{c}|{s}".replace(" ", "") for f, c, s, _ in out], [k for *_, k in out]]

            for _, text in rows:
                held.append(text or "")
                if len(held) >= SLICE_ROWS:
                    yield cases(held)
                    held = []
            yield cases(held)

        return work

    rows = scan_many(sample, "case string, label int", factory).groupBy("case", "label").count().collect()
    if not rows:
        return w0, chain0, skip0
    x = np.zeros((len(rows), len(FEATURES) + 2 * L))
    for i, r in enumerate(rows):
        f, c, s = (np.fromstring(part.strip("[]"), sep=",") for part in r["case"].split("|"))
        x[i, f.astype(int)] = 1
        x[i, len(FEATURES) :] = np.concatenate([c, s])
    y, n = np.array([r["label"] for r in rows]), np.array([float(r["count"]) for r in rows])
    start = np.vstack([w0, chain0, skip0])
    weights, pull = start.copy(), 2.0
    target = np.zeros((len(rows), L))
    target[np.arange(len(rows)), y] = 1
    squares = np.full_like(weights, 1e-8)
    for _ in range(300):
        z = x @ weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x.T @ ((z / z.sum(axis=1, keepdims=True) - target) * n[:, None]) + pull * (weights - start)
        squares += grad**2
        weights -= 0.3 * grad / np.sqrt(squares)
    w, chain, skip = weights[: len(FEATURES)], weights[len(FEATURES) : -L], weights[-L:]
    # agreement never counts against a label: repeated values may not talk each other out of it
    skip = np.maximum((skip + skip.T) / 2, 0) * np.eye(L)
    return w, (chain + chain.T) / 2, skip


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of docs."""
    model = model or fit(docs, id_col, text_col)
    write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = spans_of(part.column(1).to_pylist(), model)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([sha256_hex(write(base)) for base, _ in found])
                spans = pa.array([write(base + added) for base, added in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, digests, spans, pa.array([len(a) for _, a in found], pa.int64())],
                    names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return long_text(docs, id_col, text_col).mapInArrow(
        run,
        f"{id_col} bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint",
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlapping ones together) replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact_column(model: Model):
    """A column function from text to text without personal data; null stays null."""

    def make() -> Callable[[list], list]:
        return lambda texts: [t if t is None else redacted(t, base + added) for t, (base, added) in zip(texts, spans_of(texts, model), strict=True)]

    return text_column(T.StringType(), make)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with personal data in text replaced by [KIND]; n_chars, if there is one, follows the text."""
    model = model or fit(docs)
    out = docs.withColumn("text", redact_column(model)(docs["text"]))
    return out.withColumn(
        "n_chars",
        F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)),
    ) if "n_chars" in docs.columns else out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
ORACLE_SQL: dict[str, str] = {}
