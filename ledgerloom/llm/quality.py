"""Quality classifier by importance resampling.

Hashed unigrams and bigrams of words give two bag models: of target texts (those labelled as good) and of all raw texts.
A text's weight is the log ratio of its probability under the target model to that under the raw model. Texts are
sampled without replacement in proportion to their weights by Gumbel top-k: a text's key is its log weight plus Gumbel
noise from a hash of its id and text; the k largest keys are the sample, k a share of all rows (SHARE).

Counts for both models come from all rows, summed within tasks before the shuffle; what comes to the driver is BUCKETS
numbers for each model. The k-th largest key is found by narrowing histograms over all rows, never by sorting into one
task.

Null or empty texts have no n-grams: weight 0, and they are never selected. Ties in the key go to the smaller id, and
repeated rows, which tie in everything, are selected together or not (so a sample may hold a few rows more than k). An empty
table gives an empty result; without target texts all ratios are those of the smoothing. Texts of any length are read whole, in
memory proportional to their words. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, scan, scan_many, table, words_of

BUCKETS = 1 << 14
SHARE = 0.1
#: Added to each bucket's count in both models.
SMOOTHING = 1.0
BINS = 4096
#: Target ids that are broadcast at most (16 bytes each or so); beyond it, they are joined.
IDS_MOST = 1 << 20


def ngrams(text: str | None) -> np.ndarray:
    """Bucket of each word and of each pair of neighbours."""
    words = words_of(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(h) > 1 else h[:0]
    both = np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), pair])
    return (both >> np.uint64(50)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams in each bucket: of all rows, and of target rows. texts: (target boolean, text)."""

    def factory() -> Callable:
        def work(rows: Iterator[tuple]) -> Iterator[list]:
            raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
            for target, text in rows:
                counts = np.bincount(ngrams(text), minlength=BUCKETS)
                raw += counts
                if target:
                    good += counts
            some = np.flatnonzero(raw)
            yield [some, raw[some], good[some]]

        return work

    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in scan_many(
        texts,
        "bucket bigint, raw bigint, good bigint",
        factory,
    ).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    return raw, good


def gumbel(doc_id: int | None, text: str, seed: int) -> float:
    """Standard Gumbel noise from a hash."""
    import xxhash

    u = (xxhash.xxh3_64_intdigest(f"{doc_id}\0{text}".encode("utf-8", "surrogatepass"), seed=seed) + 0.5) / 2**64
    return float(-np.log(-np.log(u)))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of column key, by histograms that narrow to a few thousand rows."""
    if k <= 0:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return None
    inside = F.lit(True)
    while high > low:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = sorted(
            (
                (r["bin"], r["count"], r["least"], r["most"])
                for r in keys.where(inside).groupBy(at.alias("bin")).agg(
                    F.count("*").alias("count"),
                    F.min("key").alias("least"),
                    F.max("key").alias("most"),
                ).collect()
            ),
            reverse=True,
        )
        for _, count, least, most in bins:
            if k <= count:
                low, high = least, most
                break
            k -= count
        else:
            return low
        inside = F.col("key").between(low, high)
    return low


def importance(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, seed: int = 11) -> DataFrame:
    """doc_id, n_grams, log_ratio (for each n-gram), log_weight, gumbel_key, selected for every row of docs. target_ids:
    ids (column id) of target texts."""
    marks = target_ids.select(F.col("id").alias("__target")).where("__target IS NOT NULL").distinct()
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    few = marks.limit(IDS_MOST + 1).count() <= IDS_MOST
    raw, good = bucket_counts(
        texts.join(
            F.broadcast(marks) if few else marks,
            texts["id"] == marks["__target"],
            "left",
        ).select(F.col("__target").isNotNull().alias("target"), "text"),
    )
    ratio = np.log((good + SMOOTHING) / (good.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))
    kept = docs.sparkSession.sparkContext.broadcast(ratio.tobytes())

    def factory() -> Callable:
        ratio = np.frombuffer(kept.value)

        def work(doc_id: int | None, text: str | None) -> tuple:
            grams = ngrams(text)
            if not len(grams):
                return doc_id, 0, 0.0, 0.0, None
            weight = float(ratio[grams].sum())
            return doc_id, len(grams), weight / len(grams), weight, weight + gumbel(doc_id, text, seed)

        return work

    scored = checkpointed(scan(texts, "id bigint, n_grams bigint, log_ratio double, log_weight double, key double", factory))
    k = round(share * scored.count())
    least = kth_largest(scored.where("key IS NOT NULL"), k)
    if least is None:
        chosen = F.lit(False)
    else:
        # rows above the threshold, then ties by id
        above = scored.where(F.col("key") > F.lit(least)).count()
        ties = scored.where(F.col("key") == F.lit(least)).groupBy("id").count().orderBy(F.col("id").asc_nulls_last()).limit(max(1, k - above))
        last = ties.agg(F.max("id")).first()[0]
        tied = (F.col("key") == F.lit(least)) & ((F.col("id") <= F.lit(last)) if last is not None else F.lit(True))
        chosen = F.coalesce((F.col("key") > F.lit(least)) | tied, F.lit(False))
    return scored.select(F.col("id").alias(id_col), "n_grams", "log_ratio", "log_weight", F.col("key").alias("gumbel_key"), chosen.alias("selected"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return importance(table(spark, sf_dir, "documents"), good)


QUERIES = {"op7_quality": op7_quality}
ORACLE_SQL: dict[str, str] = {}
