"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is the word. The patterns are the windows of the benchmark items: 10 consecutive words, or a whole item of
fewer. Windows of one length form a group. For each group a shift table holds, for every block of two words in a window,
how far the search may jump; a pair of words in no window jumps over the whole window but one word. At shift 0 the
bucket of the window's last two words names the windows to compare word by word.

Windows are dealt into blocks of a bounded number of bytes and each block is broadcast for a pass of its own over the
documents, so the benchmark may outgrow any one task; the driver holds one block at a time, and a block's broadcast is freed after
its pass. Several passes are merged for each document.

Null text has no words and is never hit. A null item_id takes no part; a repeated item_id is one item with the windows of all
its rows. Each input row gives one row, repeated rows too; empty documents give an empty result, and without a benchmark nothing
is hit. Texts of any length are searched whole, in memory proportional to their words. Only the ids and texts are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, long_text, scan, scan_many, sha256_hex, table, text_column, words_of

WINDOW = 10
#: Bytes of distinct windows that one pass broadcasts at most, on average over the blocks.
BLOCK_BYTES = 4 << 20


class WuManber:
    """Windows of words with the ids that hold them: {words joined by a blank: [ids]}."""

    def __init__(self, windows: dict[bytes, list]) -> None:
        self.ids: list[list] = []
        groups: dict[int, list[tuple[tuple[bytes, ...], int]]] = defaultdict(list)
        for joined, ids in windows.items():
            words = tuple(joined.split(b" "))
            groups[len(words)].append((words, len(self.ids)))
            self.ids.append(ids)
        self.groups = []
        for m, members in groups.items():
            b = min(2, m)
            shift: dict = {}
            bucket: dict = defaultdict(list)
            for words, k in members:
                for end in range(b, m + 1):
                    block = words[end - b : end] if b == 2 else words[end - 1]
                    if shift.get(block, m) > m - end:
                        shift[block] = m - end
                bucket[words[m - b :] if b == 2 else words[m - 1]].append((words, k))
            self.groups.append((m, b, shift, dict(bucket)))

    def search(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, length, window) of every occurrence."""
        found, n = [], len(words)
        for m, b, shift, bucket in self.groups:
            jump, at, get = m - b + 1, m, shift.get
            if b == 1:
                found += [(i, 1, k) for i, w in enumerate(words) if w in bucket for _, k in bucket[w]]
                continue
            while at <= n:
                block = (words[at - 2], words[at - 1])
                s = get(block, jump)
                if s:
                    at += s
                    continue
                start = at - m
                for window, k in bucket[block]:
                    if window[0] == words[start] and window == tuple(words[start:at]):
                        found.append((start, m, k))
                at += 1
        return found


def windows_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, item ids as sorted strings) of every distinct window."""

    def factory() -> Callable:
        def work(rows: Iterator[tuple]) -> Iterator[list]:
            for item, text in rows:
                words = words_of(text)
                if item is None or not words:
                    continue
                n = max(1, len(words) - width + 1)
                seen = {b" ".join(words[i : i + width]) for i in range(n)}
                yield [list(seen), [item] * len(seen)]

        return work

    pairs = scan_many(
        benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].alias("text")),
        "window binary, item string",
        factory,
    )
    return pairs.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Blocks:
    """The windows in blocks of about block_bytes, dealt by their hash; one block, empty, if there are none."""

    def __init__(self, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, width: int = WINDOW) -> None:
        self.windows = checkpointed(windows_of(benchmark, width=width))
        total = self.windows.agg(F.sum(F.octet_length("window") + 24 * F.size("items"))).first()[0] or 0
        self.n = max(1, -(-total // block_bytes))

    def broadcast(self, i: int) -> Broadcast:
        rows = self.windows.where(F.pmod(F.xxhash64("window"), F.lit(self.n)) == i).collect()
        return self.windows.sparkSession.sparkContext.broadcast({bytes(r["window"]): list(r["items"]) for r in rows})

    def each(self, one_pass: Callable[[Broadcast], DataFrame]) -> DataFrame:
        """The rows of one_pass for every block, each kept before its block goes."""
        out = None
        for i in range(self.n):
            kept = self.broadcast(i)
            rows = checkpointed(one_pass(kept))
            kept.destroy()
            out = rows if out is None else out.unionByName(rows)
        return out


def with_digest(texts: DataFrame, text_col: str) -> DataFrame:
    return texts.withColumn("digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    texts = long_text(docs, id_col, text_col)
    blocks = Blocks(benchmark, block_bytes, width)
    out = f"{id_col} bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    def summary(n_words: int, marks: bytes | bytearray, items: set) -> tuple:
        hit = marks.count(1)
        return n_words, hit, len(items), sha256_hex(",".join(sorted(items))), hit > 0

    if blocks.n == 1:
        kept = blocks.broadcast(0)

        def factory() -> Callable:
            search = WuManber(kept.value)

            def work(doc_id: int | None, text: str | None) -> tuple:
                words = words_of(text)
                marks, which = bytearray(len(words)), set()
                for start, m, k in search.search(words):
                    marks[start : start + m] = b"\1" * m
                    which.add(k)
                return doc_id, *summary(len(words), marks, set().union(*(search.ids[k] for k in which)))

            return work

        return scan(texts, out, factory)

    # Several blocks: each pass gives hit documents only, by a digest of the text, and the passes are merged.
    keyed = with_digest(texts, text_col)

    def one_pass(kept: Broadcast) -> DataFrame:
        def factory() -> Callable:
            search = WuManber(kept.value)

            def work(rows: Iterator[tuple]) -> Iterator[list]:
                for text, digest in rows:
                    if found := search.search(words_of(text)):
                        items = sorted(set().union(*(search.ids[k] for _, _, k in found)))
                        longest = {a: m for a, m, _ in sorted(found)}
                        yield [[digest], [list(longest)], [list(longest.values())], [items]]

            return work

        return scan_many(keyed.select(text_col, "digest"), "digest string, starts array<bigint>, lengths array<bigint>, items array<string>", factory)

    hits = blocks.each(one_pass)
    merged = hits.groupBy("digest").agg(
        F.flatten(F.collect_set(F.arrays_zip("starts", "lengths"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    merged = merged.select("digest", F.col("spans.starts").alias("starts"), F.col("spans.lengths").alias("lengths"), "items")
    joined = keyed.join(merged, "digest", "left").select(id_col, text_col, "starts", "lengths", "items")

    def merge_factory() -> Callable:
        def work(doc_id, text, starts, lengths, items) -> tuple:
            words = words_of(text)
            marks = bytearray(len(words))
            for start, m in zip(starts or (), lengths or (), strict=True):
                marks[start : start + m] = b"\1" * m
            return doc_id, *summary(len(words), marks, set(items or ()))

        return work

    return scan(joined, out, merge_factory)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark window, with their columns."""
    blocks = Blocks(benchmark, block_bytes)
    if blocks.n == 1:
        kept = blocks.broadcast(0)

        def make() -> Callable[[list], list]:
            search = WuManber(kept.value)
            return lambda texts: [bool(search.search(words_of(t))) for t in texts]

        return docs.where(~text_column(T.BooleanType(), make)(docs["text"]))
    keyed = with_digest(docs.select("text"), "text")

    def one_pass(kept: Broadcast) -> DataFrame:
        def factory() -> Callable:
            search = WuManber(kept.value)
            return lambda rows: ([[digest]] for text, digest in rows if search.search(words_of(text)))

        return scan_many(keyed, "hit string", factory)

    hits = blocks.each(one_pass).distinct()
    return docs.join(hits, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == hits["hit"], "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)),
occ AS (SELECT dw.doc_id, dw.i, dw.m, win.item_id FROM dw JOIN win ON dw.m = win.m AND dw.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
