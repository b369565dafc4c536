"""Packing of tokens into sequences by Karmarkar-Karp multiway differencing.

A document's tokens are cut into whole windows, each a sequence at once, and a tail shorter than a window. The tails of a stretch of
rows form a group, bounded in tokens and in tails. A group's tails are dealt into the least number of windows that could hold
them: each tail starts as a partition of its own, and the two partitions of the largest spread merge, the heaviest window of one
with the lightest of the other, until one is left whose windows are near-equal. While its heaviest exceeds the capacity, the
number of windows rises and the group is dealt again.

Near-equal windows share out what padding there is. As documents may be cut, the lightest windows are then dissolved to fill the
others to capacity, and what remains is cut into sequences of powers of two, which need no padding.

Groups lie within Spark's partitions, so nothing is shuffled, and a task holds one group: its memory doesn't grow with the table. A
sequence's id is the partition's number times 2^33 plus a count. A task that runs again packs the same rows into the same
sequences if its partition gives them in the same order, as files do; rows that come from a shuffle should be written or checkpointed first.

Words are looked up in a memo that a worker keeps from task to task, of bounded size; the tokenizer itself runs once for
each new word. Splitting at ASCII white space and between a letter A to Z and a run of full stops, commas and the like that ends a word is
exact, as the vocabulary's own rule splits there too; A-Z become small first unless the text has a combining mark or the start of a special token's
name, where that might change the result. All else is the library's.

Null and empty texts have one token, the end of a document. A null id is packed as any; repeated rows are documents of their own. Texts of any length
are packed whole, in memory proportional to their tokens. An empty table gives an empty result. Only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import heapq
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY = 4096
END_ID = 2
#: A group's tails: so many tokens and tails at most (and one tail more).
GROUP_TOKENS, GROUP_TAILS = 1 << 20, 4096
#: Different words that a worker remembers, and the longest of them in bytes.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 64
#: Rows, and bytes of their texts (but for one text), that are split at once.
ROWS, ROWS_BYTES = 1024, 4 << 20


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A near-equal partition of the sizes into k windows: each item's window, and the windows' sums."""
    n = len(sizes)
    sums = [None] * (2 * n - 1)
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        own = np.zeros(k, np.int64)
        own[0] = size
        sums[i] = own
        heap.append((-size, i))
    heapq.heapify(heap)
    for new in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]  # each in falling order
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        sums[new] = both
        merged.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (int(both[-1] - both[0]), new))
    # from the last partition down: where each window of a partition ends up
    place = {2 * n - 2: np.arange(k, dtype=np.int32)}
    window = np.zeros(n, np.int64)
    for new in range(2 * n - 2, n - 1, -1):
        a, b, order = merged[new - n]
        here = np.empty(k, np.int32)
        here[order] = place.pop(new)
        place[a], place[b] = here, here[::-1]
    for i in range(n):
        window[i] = place[i][0]
    return window, sums[2 * n - 2]


def dealt(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Near-equal windows none of which exceeds the capacity: each item's window, and the sums."""
    k = -(-int(sizes.sum()) // capacity)
    while True:
        window, sums = differencing(sizes, k)
        over = np.maximum(sums - capacity, 0).sum()
        if not over:
            return window, sums
        k += max(1, int(over) // capacity)


def levelled(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length): full ones, and the rest in powers of two."""
    window, sums = dealt(sizes, capacity)
    full = int(sizes.sum()) // capacity
    order = np.argsort(-sums, kind="stable")
    members: list[list[int]] = [[] for _ in sums]
    for i, w in enumerate(window.tolist()):
        members[w].append(i)
    rest = [i for w in order[full:].tolist() for i in members[w]][::-1]
    begun = {}

    def taken(wanted: int) -> Iterator[tuple[int, int, int]]:
        while wanted:
            i = rest[-1]
            start = begun.get(i, 0)
            length = min(wanted, int(sizes[i]) - start)
            yield i, start, length
            wanted -= length
            begun[i] = start + length
            if begun[i] == sizes[i]:
                rest.pop()

    out = []
    for w in order[:full].tolist():
        out.append([(i, 0, int(sizes[i])) for i in members[w]] + list(taken(capacity - int(sums[w]))))
    left = int(sizes.sum()) - full * capacity
    return out + [list(taken(1 << bit)) for bit in reversed(range(left.bit_length())) if left >> bit & 1]


class Tokens:
    """Ids of batches of texts, as the tokenizer's file has them; memo: words known so far."""

    def __init__(self, path: str, memo: dict[str, bytes]) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = memo

    def _new(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        others = []
        for i, word in enumerate(words):
            if word.isascii() and word.isalpha() and word.islower():
                out[i] = array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
            else:
                others.append(i)
        for i, made in zip(others, self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = array("I", made.ids).tobytes()
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        get = self.memo.get
        found = [get(w) for w in words]
        missing = [i for i, f in enumerate(found) if f is None]
        for i, new in zip(missing, self._new([words[i] for i in missing]), strict=True):
            found[i] = new
            if len(words[i]) <= MEMO_BYTES and len(self.memo) < MEMO_WORDS:
                self.memo[words[i]] = new
        return found

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # before ascii_lower, which reads slices wrongly: the result starts at offset 0
        texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?]+)(\s|$)", r"\1 \2\3")
        plain = pc.invert(pc.match_substring_regex(texts, r"\p{M}|<\|"))
        texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
        parts = pc.ascii_split_whitespace(texts)
        bounds = parts.offsets.to_numpy(zero_copy_only=False)
        words = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        known = self._known(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        starts = np.cumsum(lengths) - lengths
        codes = words.indices.to_numpy(zero_copy_only=False)
        n = lengths[codes]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)]
        cuts = np.concatenate([[0], ends])[bounds - bounds[0]]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of ROWS rows and ROWS_BYTES bytes, or of one longer text."""
    first, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and (i - first >= ROWS or size + n > ROWS_BYTES):
            yield first, i - first
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts) - first


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset. The file
    at tokenizer_path is read on every executor."""
    memo = docs.sparkSession.sparkContext.broadcast({})  # each worker unpickles it once and keeps its own
    out = pa.schema(
        [
            (id_col, pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer_path, memo.value)
        made = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        tails: list[tuple] = []  # id, start, ids, tokens of the document
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=out)

        def pack() -> None:
            nonlocal made, held
            for sequence in levelled(np.array([len(t[2]) for t in tails], np.int64), capacity):
                offset = 0
                for i, start, length in sequence:
                    doc_id, before, ids, total = tails[i]
                    rows.append((doc_id, before + start, length, ids[start : start + length].tobytes(), total, made, offset))
                    offset += length
                made += 1
            tails.clear()
            held = 0

        for batch in batches:
            for at, n in stretches(batch.column(1)):
                part = batch.slice(at, n)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.of(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        rows.append((doc_id, start, capacity, ids[start : start + capacity].tobytes(), len(ids), made, 0))
                        made += 1
                    if whole < len(ids):
                        tails.append((doc_id, whole, ids[whole:], len(ids)))
                        held += len(ids) - whole
                    if held >= GROUP_TOKENS or len(tails) >= GROUP_TAILS:
                        pack()
                    if len(rows) >= 1024:
                        yield flush()
        if tails:
            pack()
        if rows:
            yield flush()

    texts = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    return texts.mapInArrow(run, f"{id_col} bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, doc_ids, ids (binary): each sequence's pieces joined in order; at most a window's pieces meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return whole.select(
        "sequence_id",
        "length",
        F.col("parts.doc_id").alias("doc_ids"),
        F.aggregate("parts.ids", F.lit(b""), lambda acc, ids: F.concat(acc, ids)).alias("ids"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {"op12_packing": op12_packing}
ORACLE_SQL: dict[str, str] = {}
