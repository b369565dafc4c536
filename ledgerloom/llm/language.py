"""Language identification by hierarchical discrimination.

A first set of linear support vector machines predicts the family of a text's language; within the family, one-versus-one
linear support vector machines separate the languages, which are closely related. Features are hashed character
trigrams of whole texts in small letters, weighted by relative frequency.

Codes outside FAMILIES are grouped by their own texts: about the square root of their number of groups, around languages
that are far apart, so the number of machines stays well below the square of the number of languages.

The machines learn from a bounded, documented sample of labelled rows (TRAIN_DOCS for each language, about, and TRAIN_MOST
in all, by a hash of the row's id); rows whose crc32(id as text) mod 5 is 0 are held out and never learned from. A
language with very few rows among very many languages may have none in the sample and is then not predicted. Prediction
uses the text only.

A text that is null or has no letter is `und`, score 0. With no rows to learn from (or an empty table), every text is
`und`. Ties of votes go to the larger sum of margins, then to the code that comes first. Each input row gives one row,
repeated rows too. Texts of any length are read whole, in time and memory proportional to their length. Only id, text and
label are read, so other columns may have any name.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_object, long_text, scan, scan_many, table, text_column

UNKNOWN = "und"
#: Labelled rows of each language that are learned from, about; and in all, at most.
TRAIN_DOCS, TRAIN_MOST = 600, 12_000
#: Hashed features.
DIM = 1 << 12

#: keep_known() rejects scores below this: even odds at both levels.
LEAST_SCORE = 0.25

# Families of languages by their codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> bytes:
    """Small letters with single blanks between words and around; nothing if no character is a letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def trigrams(line: bytes) -> np.ndarray:
    """Hashed features of all byte trigrams, in order."""
    b = np.frombuffer(line, np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.concatenate([b, np.zeros(3 - len(b), np.uint32)])
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(20)).astype(np.int32)


def features(line: bytes) -> np.ndarray:
    """Square roots of relative frequencies: a vector of length 1, so long and short texts are alike."""
    counts = np.bincount(trigrams(line), minlength=DIM).astype(np.float64)
    return np.sqrt(counts / counts.sum())


class Machines:
    """Support vector machines: for each pair of classes (a, b) weights and bias; positive means a."""

    def __init__(self, classes: list[str]) -> None:
        self.classes = classes
        self.pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = {}

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        for a, b in combinations(self.classes, 2):
            rows = (y == a) | (y == b)
            self.pairs[a, b] = svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class with the most votes, then the largest sum of margins; and how sure its weakest vote is, 0 to 1."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        votes, margins = defaultdict(float), defaultdict(list)
        for (a, b), (w, bias) in self.pairs.items():
            m = float(x @ w + bias)
            votes[a if m >= 0 else b] += 1
            margins[a].append(m)
            margins[b].append(-m)
        best = min(self.classes, key=lambda c: (-votes[c], -sum(margins[c]), c))
        return best, 1 / (1 + np.exp(-2 * min(margins[best])))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent, with a constant feature for the bias; rows in a fixed order."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))  # classes count alike
    alpha, w, bias, order = np.zeros(len(y)), np.zeros(x.shape[1]), 0.0, np.random.default_rng(7)
    norms = np.einsum("ij,ij->i", x, x) + 1
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w + bias) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), c * weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, float(bias)


def families_of(x: np.ndarray, langs: np.ndarray) -> dict[str, str]:
    """The family of each language: that of FAMILIES, else a group of languages with similar texts, named by its first
    centre. Centres are picked farthest first, by cosine of the mean features; ties go to the code that comes first."""
    known = sorted(set(langs))
    out = {lang: FAMILY_OF[lang] for lang in known if lang in FAMILY_OF}
    rest = [lang for lang in known if lang not in out]
    if not rest:
        return out
    mean = np.stack([x[langs == lang].mean(axis=0, dtype=np.float64) for lang in rest])
    mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    centres, nearest = [0], mean @ mean[0]
    while len(centres) ** 2 < len(rest):
        centres.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, mean @ mean[centres[-1]])
    group = (mean @ mean[centres].T).argmax(axis=1)
    return out | {lang: f"like {rest[centres[g]]}" for lang, g in zip(rest, group, strict=True)}


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        self.family_of = families_of(x, langs)
        family = np.array([self.family_of[lang] for lang in langs], dtype=object)
        self.families = Machines(sorted(set(family)))
        self.families.learn(x, family)
        self.within: dict[str, Machines] = {}
        for f in self.families.classes:
            rows = family == f
            self.within[f] = Machines(sorted(set(langs[rows])))
            self.within[f].learn(x[rows], langs[rows])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not (line := letters_of(text)) or not self.families.classes:
            return UNKNOWN, 0.0
        x = features(line)
        family, sure = self.families.predict(x)
        lang, within = self.within[family].predict(x)
        return lang, float(min(max(sure * within, 0.0), 1.0))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from about train_docs rows of each language, picked by a hash of their ids."""
    rows = docs.select(
        docs[id_col].cast("long").alias("id"),
        docs[text_col].alias("text"),
        docs[label_col].alias("lang"),
    ).where("lang IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(~held_out("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # as many as there are languages
    if not counts:
        return Model(np.zeros((0, DIM), np.float32), np.zeros(0, dtype=object))
    each = min(train_docs, TRAIN_MOST / len(counts))
    shares = docs.sparkSession.createDataFrame([(lang, int((1 << 40) * min(1.0, each / n))) for lang, n in counts.items()], "lang string, share long")
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 40)) < F.col("share")).select("id", "text", "lang")

    def factory() -> Callable:
        def work(found: Iterator[tuple]) -> Iterator[list]:
            for key, text, lang in found:
                if line := letters_of(text):
                    yield [[key], [lang], [features(line).astype(np.float32).tobytes()]]

        return work

    got = scan_many(sample, "id bigint, lang string, x binary", factory).toArrow().sort_by([("id", "ascending"), ("lang", "ascending"), ("x", "ascending")])
    x = np.zeros((got.num_rows, DIM), np.float32)
    for row, v in zip(x, got.column("x"), strict=True):
        row[:] = np.frombuffer(v.as_buffer(), np.float32)
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    del got
    return Model(x, langs)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    kept = broadcast_object(docs.sparkSession, learn(docs, id_col, text_col, label_col))

    def factory() -> Callable:
        model = pickle.loads(kept.value)
        return lambda doc_id, text: (doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0, *model.predict(text))

    return scan(long_text(docs, id_col, text_col), f"{id_col} bigint, held_out boolean, lang_pred string, score double", factory)


def keep_known(docs: DataFrame, languages: Collection[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is known: those predicted as one of the languages (all, if None) with a score of
    least or more; the others go, and so do texts without a letter. A null lang becomes the prediction. If there is
    nothing to learn from, nothing can be told and all rows stay as they are."""
    model = learn(docs)
    if not model.families.classes:
        return docs
    kept = broadcast_object(docs.sparkSession, model)

    def make() -> Callable[[list], list]:
        model = pickle.loads(kept.value)

        def decide(text: str | None) -> str | None:
            lang, score = model.predict(text)
            return lang if lang != UNKNOWN and score >= least and (languages is None or lang in languages) else None

        return lambda texts: [decide(t) for t in texts]

    found = docs.withColumn("__predicted", text_column(T.StringType(), make)(docs["text"])).where("__predicted IS NOT NULL")
    return found.withColumn("lang", F.coalesce("lang", "__predicted")).drop("__predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op8_language": op8_language}
ORACLE_SQL: dict[str, str] = {}
