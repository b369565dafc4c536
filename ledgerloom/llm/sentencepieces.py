"""SentencePiece encoding and decoding by suffix-array matching.

For a batch of texts, the words that are new to the task are concatenated and indexed by a suffix array (sorted to the depth
of the longest piece). Every piece of the vocabulary is looked up by binary search for its range of occurrences; each
occurrence is an edge. Edges are sorted by position and relaxed from left to right, over all stretches that no piece can
cross at once; the pieces of a word are remembered, within a bound.

The model is a byte-pair one: its encoding is the only path whose neighbouring pieces are compatible, which means that
merging the two pieces' characters by priority gives just these two pieces. So the relaxation keeps, for each position,
the edge that is compatible with the best piece before it. Runs of blanks have equal priority in such models and are
merged last, leftmost first. Characters outside the vocabulary become byte pieces.

Supported are byte-pair models with the identity normaliser, the dummy prefix and byte fallback; others raise ValueError.

Null text gives null pieces and null decoded text; empty text gives none and the empty text. Each input row gives one row,
repeated rows too; an empty table gives an empty result. Texts of any length are encoded whole: one index holds about
INDEXED_CHARS characters, and a longer word is indexed part by part, so that besides the text a few numbers a character are held,
and time is proportional to its length. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import broadcast_object, long_text, table

DEFAULT_MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Rows and characters that are encoded together, about.
BATCH_ROWS, BATCH_CHARS = 1024, 4_000_000
#: Different words and stretches whose pieces a task remembers, about.
REMEMBERED = 150_000, 250_000
#: Characters that one suffix array indexes, about; bounds the memory for its windows and edges.
INDEXED_CHARS = 200_000
#: Stretches of so many characters are relaxed together, longer ones one by one.
SHORT = 64
TABLE, FILTER_BITS = 0x250, 21


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merges(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging by rank, then from the left; the symbols that are left and the last merge."""
    symbols, last = list(symbols), None
    while True:
        options = [(rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank]
        if not options:
            return symbols, last
        _, i = min(options)
        last = (symbols[i], symbols[i + 1])
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def filter_place(keys: np.ndarray) -> np.ndarray:
    """The place of each pair in a table that tells most pairs that make no piece from the others."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Vocabulary:
    """What encoding needs of a model, as plain arrays; made once on the driver."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        bytes_of = {pieces[i]: i for i in range(n) if sp.is_byte(i)}
        if len(bytes_of) != 256 or sp.encode("a  bΩ", out_type=str)[0][0] != BLANK or sp.normalize("a  bΩ") != f"{BLANK}a{BLANK}{BLANK}bΩ":
            raise ValueError("only byte-pair models with the identity normaliser, the dummy prefix and byte fallback are supported")
        self.byte_ids = np.array([bytes_of[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        self.text = [b"" for _ in pieces]
        for b, i in enumerate(self.byte_ids):
            self.text[i] = bytes([b])
        for i in normal:
            self.text[i] = pieces[i].replace(BLANK, " ").encode()
        self.run_ids = {len(pieces[i]): i for i in normal if set(pieces[i]) == {BLANK}}
        own = sorted((i for i in normal if not (len(pieces[i]) > 1 and set(pieces[i]) == {BLANK})), key=lambda i: (-sp.get_score(i), i))
        if any(BLANK in pieces[i][1:] for i in own):
            raise ValueError("only models whose pieces don't cross blanks are supported")
        singles, longer = [i for i in own if len(pieces[i]) == 1], [i for i in own if len(pieces[i]) > 1]
        # labels: characters first, then pieces by priority
        label = {pieces[i]: k for k, i in enumerate(singles + longer)}
        rank = {pieces[i]: k for k, i in enumerate(longer)}
        self.ids = np.array(singles + longer, np.int32)
        m = len(label)
        self.left, self.right = np.arange(m), np.arange(m)
        keep = np.ones(m, bool)
        for i in longer:
            left, last = merges(list(pieces[i]), rank)
            if len(left) > 1:
                keep[label[pieces[i]]] = False  # other merges always come first
            else:
                self.left[label[pieces[i]]], self.right[label[pieces[i]]] = label[last[0]], label[last[1]]
        pairs = {}
        for i in longer:
            p = pieces[i]
            for c in range(1, len(p)):
                if p[:c] in label and p[c:] in label:
                    pairs[label[p[:c]] << 20 | label[p[c:]]] = label[p]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pair_filter = np.zeros(1 << FILTER_BITS, bool)
        self.pair_filter[filter_place(self.pair_keys)] = True
        kept = sorted(p for p, k in label.items() if keep[k])  # searches in order touch neighbouring memory
        self.depth = max(map(len, kept), default=1)
        self.piece_labels = np.array([label[p] for p in kept], np.int64)
        self.length_of = np.zeros(m, np.int64)
        self.length_of[self.piece_labels] = [len(p) for p in kept]
        codes = np.zeros((len(kept), self.depth), ">u4")
        for row, p in zip(codes, kept, strict=True):
            row[: len(p)] = [ord(c) + 1 for c in p]
        self.piece_low = codes.view(f"S{4 * self.depth}").ravel()
        high = codes.copy()
        high[codes == 0] = 0xFFFFFFFF
        self.piece_high = high.view(f"S{4 * self.depth}").ravel()
        bigrams = sorted({ord(a) << 21 | ord(b) for p in kept for a, b in zip(p, p[1:], strict=False)})
        self.bigrams = np.array(bigrams, np.int64)
        self.small = np.zeros((TABLE, TABLE), bool)
        for k in bigrams:
            if k >> 21 < TABLE and k & 0x1FFFFF < TABLE:
                self.small[k >> 21, k & 0x1FFFFF] = True
        self.known_codes = np.array(sorted(ord(p) for p in label if len(p) == 1), np.uint32)
        self.plain: tuple | None = None

    def joined(self, x: np.ndarray) -> np.ndarray:
        """For neighbouring characters, whether some piece holds both."""
        a, b = x[:-1], x[1:]
        out = self.small[np.minimum(a, TABLE - 1), np.minimum(b, TABLE - 1)]
        if len(wide := np.flatnonzero((a >= TABLE - 1) | (b >= TABLE - 1))):
            k = a[wide].astype(np.int64) << 21 | b[wide].astype(np.int64)
            at = np.minimum(np.searchsorted(self.bigrams, k), len(self.bigrams) - 1)
            out[wide] = self.bigrams[at] == k
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by priority leaves pieces a and b side by side: undo their merges, the latest first, and see
        whether at any time a merge across the border would have come first."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(live):
            k = a << 20 | b
            crossed = self.pair_filter[filter_place(k)]
            ask = np.flatnonzero(crossed)
            at = np.minimum(np.searchsorted(self.pair_keys, k[ask]), len(self.pair_keys) - 1)
            crossed[ask] = (self.pair_keys[at] == k[ask]) & (self.pair_made[at] < limit[ask])
            out[live[crossed]] = False
            a_next, b_next = self.right[a], self.left[b]
            a_can, b_can = a_next != a, b_next != b
            undo_a = a_can & ((a > b) | ~b_can)
            undo_b = b_can & ~undo_a
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, a_next, a), np.where(undo_b, b_next, b)
            go = ~crossed & (undo_a | undo_b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return out

    def compatible_one(self, a: int, b: int) -> bool:
        """compatible() of a single pair."""
        if self.plain is None:
            self.plain = dict(zip(self.pair_keys.tolist(), self.pair_made.tolist(), strict=True)), self.left.tolist(), self.right.tolist()
        pairs, left, right = self.plain
        limit = 1 << 40
        while True:
            if pairs.get(a << 20 | b, limit) < limit:
                return False
            a_next, b_next = right[a], left[b]
            if a_next != a and (a > b or b_next == b):
                limit, a = a, a_next
            elif b_next != b:
                limit, b = b + 1, b_next
            else:
                return True


class Remembered:
    """Texts and their piece ids, in few arrays."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """New texts with their ids, one after the other, and the number of ids of each."""
        self.number.update(zip(texts, range(len(self.number), len(self.number) + len(texts)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known texts, one after the other, and the number of ids of each."""
        k = np.array(list(map(self.number.__getitem__, texts)), np.int64)
        size = self.size[k]
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.start[k] - (np.cumsum(size) - size), size)], size


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.blank = int(v.run_ids.get(1, -1))
        self.runs: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.words, self.stretches = Remembered(), Remembered()

    def learn(self, words: list[str]) -> None:
        """Pieces of new words (each stands for a blank and the word): those of their stretches, one after the other."""
        v, joined = self.v, BLANK + f"\0{BLANK}".join(words)
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2) - 1  # each word's separator
        cut = np.concatenate([[True], ~v.joined(text), [True]])
        cut[after[:-1]] = cut[after[:-1] + 1] = True
        bounds = np.flatnonzero(cut)
        own = ~np.isin(bounds[:-1], after[:-1])  # not the separators
        begin, end = bounds[:-1][own], bounds[1:][own]
        stretches = [joined[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        block, chars = [], 0
        for s in dict.fromkeys(s for s in stretches if s not in self.stretches.number):
            block.append(s)
            chars += len(s)
            if chars >= INDEXED_CHARS:
                self.stretches.add(block, *self.pieces(block))
                block, chars = [], 0
        if block:
            self.stretches.add(block, *self.pieces(block))
        ids, size = self.stretches.ids_of(stretches)
        total = np.concatenate([[0], np.cumsum(size)])
        at = total[np.searchsorted(end, after, "right")]
        self.words.add(words, ids, np.diff(at, prepend=0))

    def pieces(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of all stretches, one after the other, and their number in each. No piece crosses the end of a
        stretch where it was found, but one may where they are put together, so a separator stands between them."""
        v, lengths = self.v, np.fromiter(map(len, stretches), np.int64, len(stretches))
        text = np.frombuffer("\0".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, end = len(text), np.cumsum(lengths + 1) - 1
        begin = end - lengths
        one = end - begin == 1
        unknown = np.zeros(len(begin), bool)
        unknown[one] = ~np.isin(text[begin[one]], v.known_codes)
        best, back = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int64)
        self._relax(text, begin[~unknown], end[~unknown], best, back)
        # the path of each stretch, from its end
        on_path, is_begin = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        is_begin[begin] = True
        short = end - begin <= SHORT
        at = end[~unknown & short]
        while len(at):
            on_path[at] = True
            at = back[at]
            at = at[~is_begin[at]]
        for b, e in zip(begin[~short].tolist(), end[~short].tolist(), strict=True):
            own, steps, e_at = back[b : e + 1].tolist(), [], e
            while e_at > b:
                steps.append(e_at)
                e_at = own[e_at - b]
            on_path[steps] = True
        place = np.flatnonzero(on_path)
        ids = v.ids[best[place]]
        if unknown.any():  # byte pieces, with the place of their character
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in text[begin[unknown]].tolist()]
            place = np.concatenate([place, np.repeat(end[unknown], [len(x) for x in raw])])
            ids = np.concatenate([ids, v.byte_ids[list(b"".join(raw))]])
            order = np.argsort(place, kind="stable")
            place, ids = place[order], ids[order]
        return ids.astype(np.int32), np.diff(np.searchsorted(place, end, "right"), prepend=0)

    def _relax(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, best: np.ndarray, back: np.ndarray) -> None:
        """best and back of all places in the stretches [begin, end): index by index, each over about INDEXED_CHARS; only a
        long stretch may lie in several."""
        i, long = 0, np.append(np.flatnonzero(end - begin > SHORT), len(begin))
        following = long[np.searchsorted(long, np.arange(len(begin)))]  # of each stretch, the next long one
        while i < len(begin):
            if i == following[i]:
                for at in range(int(begin[i]), int(end[i]), INDEXED_CHARS):
                    stop = min(at + INDEXED_CHARS, int(end[i]))
                    self._relax_long(int(begin[i]), *self._edges(text, at, stop, int(end[i])), best, back)
                i += 1
                continue
            # up to the next long stretch, and a little over the bound rather than in two
            j = min(max(i + 1, int(np.searchsorted(end, begin[i] + 2 * INDEXED_CHARS, "right"))), int(following[i]))
            self._relax_short(begin[i:j], *self._edges(text, int(begin[i]), int(end[j - 1]), int(end[j - 1])), best, back)
            i = j

    def _edges(self, text: np.ndarray, low: int, high: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, label, end) of all occurrences of pieces that start in [low, high) and end by end. A suffix
        array over this stretch of text, sorted to the depth of the longest piece, gives each piece's range."""
        v, depth = self.v, self.v.depth
        part = text[low : min(end, high + depth)].astype(np.int64) + 1
        n = len(part)
        rank = np.unique(part, return_inverse=True)[1].astype(np.int64)
        width = 1
        while width < depth:  # suffixes in order of their first characters, 1, 2, 4, ... of them
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        padded = np.concatenate([part, np.zeros(depth, np.int64)]).astype(">u4")
        index = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[:n][suffixes]).view(f"S{4 * depth}").ravel()
        first, last = np.searchsorted(index, v.piece_low, "left"), np.searchsorted(index, v.piece_high, "right")
        counts = last - first
        where = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - first, counts)
        at, label = suffixes[where], np.repeat(v.piece_labels, counts)
        inside = at < high - low
        at, label = at[inside], label[inside]
        at += low
        return at, label, at + v.length_of[label]

    def _relax_short(self, begin: np.ndarray, at: np.ndarray, label: np.ndarray, end: np.ndarray, best: np.ndarray, back: np.ndarray) -> None:
        """Edges by their place within the stretch: one round for each, over all stretches."""
        first = np.zeros(int(begin[-1]) + SHORT - int(begin[0]), np.int64)
        first[begin[1:] - begin[0]] = np.diff(begin)
        first = np.cumsum(first) + begin[0]  # of each place, where its stretch begins
        offset = (at - first[at - begin[0]]).astype(np.int8)
        order = np.argsort(offset, kind="stable")
        at, label, end, offset = at[order], label[order], end[order], offset[order]
        cuts = np.searchsorted(offset, np.arange(int(offset[-1]) + 2)) if len(offset) else []
        for o, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            s, t, e = at[i:j], label[i:j], end[i:j]
            if o:
                reached = best[s] >= 0
                s, t, e = s[reached], t[reached], e[reached]
                good = self.v.compatible(best[s].astype(np.int64), t)
                s, t, e = s[good], t[good], e[good]
            best[e], back[e] = t, s

    def _relax_long(self, begin: int, at: np.ndarray, label: np.ndarray, end: np.ndarray, best: np.ndarray, back: np.ndarray) -> None:
        """The same for one stretch, edge by edge."""
        order = np.argsort(at, kind="stable")
        for s, t, e in zip(at[order].tolist(), label[order].tolist(), end[order].tolist(), strict=True):
            if s == begin or (before := int(best[s])) >= 0 and self.v.compatible_one(before, t):
                best[e], back[e] = t, s

    # ---- texts

    def run(self, size: int) -> list[int]:
        """Pieces of so many single blanks: neighbours that make a piece are merged, the leftmost first."""
        if size not in self.runs:
            ids = self.v.run_ids
            most = max(ids)
            value, left, right = [1] * size, list(range(-1, size - 1)), list(range(1, size + 1))
            heap = [i for i in range(size - 1) if 2 in ids]
            heapq.heapify(heap)
            gone = bytearray(size)
            while heap:
                i = heapq.heappop(heap)
                j = right[i]
                if gone[i] or j >= size or value[i] + value[j] > most or value[i] + value[j] not in ids:
                    continue
                value[i] += value[j]
                gone[j] = 1
                right[i] = right[j]
                if right[j] < size:
                    left[right[j]] = i
                for k in (i, left[i]):
                    if k >= 0 and right[k] < size and value[k] + value[right[k]] in ids:
                        heapq.heappush(heap, k)
            self.runs[size] = [ids[value[i]] for i in range(size) if not gone[i]]
        return self.runs[size]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self.words.number) > REMEMBERED[0]:
            self.words = Remembered()
        if len(self.stretches.number) > REMEMBERED[1]:
            self.stretches = Remembered()
        # no piece but those of blanks alone holds a blank after its first character, so words are independent
        cut = [t.replace(BLANK, " ").split(" ") if t else [] for t in texts]
        if new := list(dict.fromkeys(w for words in cut for w in words if w not in self.words.number)):
            self.learn(new)
        return [self.merged_blanks(self.words.ids_of(words)[0]) for words in cut]

    def merged_blanks(self, ids: np.ndarray) -> np.ndarray:
        alone = ids == self.blank
        if len(ids) < 2 or not (alone[1:] & alone[:-1]).any():
            return ids
        edges = np.flatnonzero(np.diff(np.concatenate([[0], alone.view(np.int8), [0]])))
        parts, done = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a > 1:
                parts += [ids[done:a], np.array(self.run(b - a), np.int32)]
                done = b
        return np.concatenate([*parts, ids[done:]])


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of piece ids: blanks for the marks, without the first one; broken bytes become U+FFFD."""
    raw = b"".join(map(v.text.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip (the decoded tokens are the text), and decoded if with_text, for every row."""
    kept = broadcast_object(docs.sparkSession, Vocabulary(model or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        encoder = Encoder(pickle.loads(kept.value))

        def made(ids: list, texts: list) -> pa.RecordBatch:
            tokens = encoder.encode([t or "" for t in texts])
            back = [None if t is None else decode(encoder.v, x) for t, x in zip(texts, tokens, strict=True)]
            sizes = [None if t is None else len(x) for t, x in zip(texts, tokens, strict=True)]
            values = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([t is None for t in texts]))
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                lists,
                pa.array([None if t is None else t == b for t, b in zip(texts, back, strict=True)], pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays(
                columns + [pa.array(back, pa.string())] * with_text,
                names=[id_col, "n_tokens", "tokens", "round_trip"] + ["decoded"] * with_text,
            )

        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if len(ids) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield made(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield made(ids, texts)

    return long_text(docs, id_col, text_col).mapInArrow(
        run,
        f"{id_col} bigint, n_tokens bigint, tokens array<int>, round_trip boolean" + ", decoded string" * with_text,
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
