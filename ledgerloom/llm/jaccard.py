"""N-gram Jaccard join with signature trees, and the classes of near-duplicates that its links make.

A document is the set of its distinct 5-word shingles (64-bit hashes); two link at a Jaccard similarity of 0.75 or more.

1. A scan gives each document's set size and a 128-bit digest of its set. Equal sets are one class from here on, named
   by its smallest doc_id: copies are never expanded into pairs. The scan also counts shingles that are frequent within
   a task's chunk; their sums name the hot shingles (a bounded number, broadcast).
2. Each class gives keys, which only say where classes meet: its smallest ordinary shingles and, if at least half of its
   shingles are hot, its HOT_KEYS smallest hot ones. Two sets with similarity s share none of their m smallest hashes
   with probability (1 - s)^m. Of a set with a hot share h, the ordinary part keeps a similarity of at least
   1 - 0.25 / (1 - h) to any set that it links with, so m follows from h: 16 keys without hot shingles, KEYS = 32 at
   one half. If both sets are at least half hot, their ordinary or their hot parts reach 0.75. A link is missed with a
   probability below MISSED. Sets of at most HOT_KEYS shingles give all of them. No key, candidate or partner is capped.
3. The classes of a key are a unit; keys with the same classes are one unit. In a unit, signature trees find the
   candidates: leaves hold sets of like size, nodes the OR of their sets' bitmaps (8 bits a shingle or more, by size)
   and their range of sizes. Two trees are walked together; a pair of nodes goes on only if sizes are within the threshold,
   the largest possible overlap (common bits of the ORs, plus shingles that share bits within a set) is enough and not
   all of their sets are one component yet. What reaches the leaves is compared exactly there, and a union-find merges
   it, so a unit of m classes gives m - 1 links at most, however many pairs of it are similar or nearly so.
4. A first wave takes the FIRST smallest keys only. Large keys are cut into blocks of about BLOCK classes, each with the
   same few anchors, so the blocks of a group of copies meet. Components follow.
5. A second wave takes all keys whose classes are still in different components. Trees on bitmaps alone name the classes
   that have a possible partner in another component; only their sets are fetched, and trees on them give links as before.
   In a large key, classes outside its largest component meet with all others, block by block; large keys of one largest
   component are joined as one, where that is less. Before they are cut into blocks, bitmaps alone are walked in coarse units
   of COARSE classes, and only classes that have a possible partner there go on: a group that shares keys but doesn't link
   is copied once for each COARSE of its classes. Components are final.

Null and empty texts have no shingles and link with nothing; an empty table gives an empty result. Rows that share a doc_id
are one document: it links by any of its texts. A null doc_id never names a class; its component_id is that of its equal
sets, else null. Repeated rows give a row each. Only the id and text columns are read, so other columns may have any name.
Very long texts are one set like others: memory of a task grows with the sets of one unit, which is bounded by BLOCK
classes and BLOCK_TOKENS shingles (or a single set, if that is larger).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, blank_words_of, checkpointed, long_text, scan_many, small_batches, table
from .components import components

SHINGLE = 5
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
KEYS, HOT_KEYS = 32, 16
#: A link's two classes share no key with less than this probability.
MISSED = 3e-10
#: Bits of a bitmap for each shingle, at least.
BITS = 8
#: Hot shingles that are broadcast at most (8 bytes each), and the count from which one is hot.
HOT_MOST, HOT_LEAST = 1 << 18, 64
#: Shingles of a chunk within which local counts are taken, and the least local count that is reported.
CHUNK, LOCAL_LEAST = 1_000_000, 4
#: Keys of each kind that the first wave takes.
FIRST = 2
#: Classes and shingles of a unit, about; and the classes that all blocks of a cut key share, about.
BLOCK, BLOCK_TOKENS, ANCHORS = 128, 1 << 21, 8
#: The same of a unit of bitmaps alone (two bytes a shingle at most).
COARSE, COARSE_TOKENS = 8192, 1 << 23
#: Rows that are broadcast at most to pick out documents (at most 64 bytes each); beyond it, they are joined.
IDS_MOST = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words, of the whole sequence."""
    import xxhash

    words = blank_words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = min(n, width)
    out = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        out = mixed(out * _P + h[i : n - m + 1 + i])
    return np.unique(out)


def digest_of(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def bits_of(n: int) -> int:
    """The length of a set's bitmap: the next power of two over BITS for each shingle, 64 at least."""
    return max(64, 1 << (BITS * n - 1).bit_length())


def bitmap_of(s: np.ndarray) -> bytes:
    bits = np.zeros(bits_of(len(s)), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def n_keys(n: int, hot: int) -> int:
    """How many ordinary keys a set gives whose hot shingles are so many of n."""
    share = hot / n
    return KEYS if share >= 0.5 else math.ceil(math.log(MISSED) / math.log(0.25 / (1 - share)))


def needed(n_a, n_b):
    """The least overlap of two sets at the threshold: I / (a + b - I) >= 3/4."""
    return -(-NUMERATOR * (n_a + n_b) // (NUMERATOR + DENOMINATOR))


def sizes_and_frequent(texts: DataFrame) -> DataFrame:
    """For each row (doc_id, n, sig), and for shingles that are frequent in a chunk (token, count)."""

    def factory() -> Callable:
        def work(rows: Iterator[tuple]) -> Iterator[list]:
            ids, ns, sigs, seen, held, size = [], [], [], set(), [], 0

            def frequent() -> list:
                values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
                keep = counts >= LOCAL_LEAST
                t, c = values[keep].view(np.int64), counts[keep]
                return [
                    pa.nulls(len(t), pa.int64()),
                    pa.nulls(len(t), pa.int64()),
                    pa.nulls(len(t), pa.binary()),
                    pa.array(t, pa.int64()),
                    pa.array(c, pa.int64()),
                ]

            for doc_id, text in rows:
                s = shingles(text)
                sig = digest_of(s)
                ids.append(doc_id)
                ns.append(len(s))
                sigs.append(sig)
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
                if len(ids) >= 4 * SLICE_ROWS:
                    yield [ids, ns, sigs, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())]
                    ids, ns, sigs = [], [], []
                if size >= CHUNK:
                    yield frequent()
                    held, size, seen = [], 0, set()
            yield [ids, ns, sigs, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())]
            yield frequent()

        return work

    return scan_many(texts, "doc_id bigint, n bigint, sig binary, token bigint, found bigint", factory)


def hot_tokens(counted: DataFrame) -> np.ndarray:
    """Sorted hot shingles: those counted HOT_LEAST times or more; if they are over HOT_MOST, the more frequent of them."""
    sums = counted.groupBy("token").agg(F.sum("found").alias("n")).where(F.col("n") >= HOT_LEAST)
    sums = checkpointed(sums)
    levels = sorted(((r["level"], r["count"]) for r in sums.groupBy(F.floor(F.log2("n") * 4).alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for level, count in levels:
        if total + count > HOT_MOST:
            break
        total, least = total + count, level
    if least is None:
        return np.zeros(0, np.uint64)
    rows = sums.where(F.floor(F.log2("n") * 4) >= least).select("token").toArrow().column(0).to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64))


def class_keys(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc_id, sig, n, keys, n_own, bitmap) of rows that may name their class: within a task, of equal sets only rows with a
    smaller doc_id than before."""
    kept = texts.sparkSession.sparkContext.broadcast(hot.tobytes())

    def factory() -> Callable:
        hot = np.frombuffer(kept.value, np.uint64)

        def work(rows: Iterator[tuple]) -> Iterator[list]:
            least: dict = {}
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in rows:
                s = shingles(text)
                sig = digest_of(s)
                if sig is None or doc_id is None or least.get(sig, doc_id + 1) <= doc_id:
                    continue
                least[sig] = doc_id
                at = np.searchsorted(hot, s) if len(hot) else None
                is_hot = hot[np.minimum(at, len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                own, shared = s[~is_hot], s[is_hot]
                own = own[: n_keys(len(s), len(shared))]
                keys = np.concatenate([own, shared[:HOT_KEYS]]) if 2 * len(shared) >= len(s) else own
                for column, value in zip(out, (doc_id, sig, len(s), keys.view(np.int64), len(own), bitmap_of(s)), strict=True):
                    column.append(value)
                if len(out[0]) >= SLICE_ROWS:
                    yield out
                    out = [[] for _ in range(6)]
            yield out

        return work

    return scan_many(texts, "doc_id bigint, sig binary, n bigint, keys array<bigint>, n_own bigint, bitmap binary", factory)


def few(rows: DataFrame) -> bool:
    """Whether rows may be broadcast."""
    return rows.limit(IDS_MOST + 1).count() <= IDS_MOST


def with_sets(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (checkpointed; id and cls name a class) with the class's tokens. A class comes once for each of its rows."""
    wanted, small = rows.select(F.col("id").alias("wanted")).distinct(), few(rows)
    picked = texts.join(F.broadcast(wanted) if small else wanted, texts["doc_id"] == F.col("wanted"), "left_semi").select("doc_id", "text")

    def factory() -> Callable:
        def work(found: Iterator[tuple]) -> Iterator[list]:
            ids, sigs, sets, size = [], [], [], 0
            for doc_id, text in found:
                s = shingles(text)
                if len(s):
                    ids.append(doc_id)
                    sigs.append(digest_of(s))
                    sets.append(s.view(np.int64))
                    size += len(s)
                if size >= 500_000:
                    yield [ids, sigs, sets]
                    ids, sigs, sets, size = [], [], [], 0
            yield [ids, sigs, sets]

        return work

    sets = scan_many(picked, "set_id bigint, sig binary, tokens array<bigint>", factory).select("set_id", F.xxhash64("sig").alias("set_cls"), "tokens")
    same = (sets["set_id"] == rows["id"]) & (sets["set_cls"] == rows["cls"])
    return sets.join(F.broadcast(rows) if small else rows, same).drop("set_id", "set_cls")


class SignatureTree:
    """Sets of one bitmap length, ordered by size and then by their smallest shingle or first bits, so that like sets are
    neighbours; each node holds the OR of its sets' bitmaps, the range of their sizes and the most shingles that share
    bits within a set. members are the sets' positions in their unit."""

    LEAF, FAN = 16, 8
    #: Words of bitmaps that a leaf compares at once, for memory.
    WORDS = 1 << 18

    def __init__(self, members: np.ndarray, n: np.ndarray, bits: np.ndarray, near: np.ndarray) -> None:
        order = np.lexsort((near, np.floor(np.log2(n) * 4)))
        self.members, self.n, self.bits = members[order], n[order], bits[order]
        self.set_bits = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.levels = [self._merged(self.LEAF, self.n, self.n, self.bits, self.n - self.set_bits)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._merged(self.FAN, *self.levels[-1]))

    @staticmethod
    def _merged(fan: int, low, high, bits, excess) -> tuple:
        cut = np.arange(0, len(low), fan)
        return np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(bits, cut, axis=0), np.maximum.reduceat(excess, cut)

    def under(self, level: int, node: int) -> slice:
        width = self.LEAF * self.FAN**level
        return slice(node * width, (node + 1) * width)

    def join(self, other: SignatureTree, done: Callable[[np.ndarray, np.ndarray], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in the unit of possible pairs, leaf by leaf, by walking both trees at once. done(a, b): whether
        nothing is to be found between the sets at these positions; it is asked again as the walk goes on."""
        stack = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while stack:
            la, i, lb, j = stack.pop()
            if other is self and la == lb and j < i:
                continue
            low_a, high_a, bits_a, ex_a = (x[i] for x in self.levels[la])
            low_b, high_b, bits_b, ex_b = (x[j] for x in other.levels[lb])
            if DENOMINATOR * high_a < NUMERATOR * low_b or DENOMINATOR * high_b < NUMERATOR * low_a:
                continue
            if int(np.bitwise_count(bits_a & bits_b).sum(dtype=np.int64)) + min(ex_a, ex_b) < needed(low_a, low_b):
                continue
            if done(self.members[self.under(la, i)], other.members[other.under(lb, j)]):
                continue
            if la == lb == 0:
                yield from self._leaf(i, other, j)
            elif la >= lb:
                stack += [(la - 1, k, lb, j) for k in range(i * self.FAN, min((i + 1) * self.FAN, len(self.levels[la - 1][0])))]
            else:
                stack += [(la, i, lb - 1, k) for k in range(j * self.FAN, min((j + 1) * self.FAN, len(other.levels[lb - 1][0])))]

    def _leaf(self, i: int, other: SignatureTree, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = self.under(0, i), other.under(0, j)
        x, y, n_b, bits_b = self.bits[a], other.bits[b], other.n[b], other.set_bits[b]
        step = max(1, self.WORDS // (x.shape[1] * max(1, len(y))))
        for at in range(0, len(x), step):
            rows = slice(a.start + at, min(a.start + at + step, a.start + len(x)))
            n_a, bits_a = self.n[rows, None], self.set_bits[rows, None]
            common = np.bitwise_count(x[at : at + step, None, :] & y[None]).sum(axis=2, dtype=np.int64)
            most = np.minimum(n_a - (bits_a - common), n_b - (bits_b - common))
            keep = (most >= needed(n_a, n_b)) & (DENOMINATOR * n_a >= NUMERATOR * n_b) & (DENOMINATOR * n_b >= NUMERATOR * n_a)
            if other is self and i == j:
                keep &= np.arange(at, at + keep.shape[0])[:, None] < np.arange(keep.shape[1])
            p, q = np.nonzero(keep)
            if len(p):
                yield self.members[rows][p], other.members[b][q]


def trees_of(positions: np.ndarray, n: np.ndarray, bitmaps: list[bytes], near: np.ndarray) -> dict[int, tuple[SignatureTree, SignatureTree | None]]:
    """By bitmap length in bytes: the tree of the sets with that length, and one of the same sets with bitmaps folded to half the
    length. Sets that may link differ by one step of length at most."""
    sizes, out = np.array([len(bitmaps[p]) for p in positions]), {}
    for size in np.unique(sizes).tolist():
        own = positions[sizes == size]
        bits = np.frombuffer(b"".join(bitmaps[p] for p in own), np.uint64).reshape(len(own), -1)
        half = bits.shape[1] // 2
        folded = SignatureTree(own, n[own], bits[:, :half] | bits[:, half:], near[own]) if size // 2 in out or size // 2 in sizes else None
        out[size] = SignatureTree(own, n[own], bits, near[own]), folded
    return out


def unit_pairs(side: np.ndarray, n: np.ndarray, bitmaps: list[bytes], near: np.ndarray, done: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs of a unit's sets: of side 0 with side 1, if there is a side 0, else of all with all."""
    if not (side == 0).any():
        trees = trees_of(np.arange(len(n)), n, bitmaps, near)
        for size, (tree, folded) in trees.items():
            yield from tree.join(tree, done)
            if folded and size // 2 in trees:
                yield from trees[size // 2][0].join(folded, done)
        return
    left, right = (trees_of(np.flatnonzero(side == s), n, bitmaps, near) for s in (0, 1))
    for size in sorted({*left, *right}):
        if size in left and size in right:
            yield from left[size][0].join(right[size][0], done)
        if size in left and 2 * size in right:
            yield from left[size][0].join(_folded(right[2 * size]), done)
        if size in right and 2 * size in left:
            yield from right[size][0].join(_folded(left[2 * size]), done)


def _folded(trees: tuple[SignatureTree, SignatureTree | None]) -> SignatureTree:
    full, folded = trees
    half = full.bits.shape[1] // 2
    return folded or SignatureTree(full.members, full.n, full.bits[:, :half] | full.bits[:, half:], full.bits[:, 0])


def unit_links(side: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Positions (a, b) of links that join the components of a unit's sets (comp: what they are in already): a spanning
    forest of all links, so fewer than there are sets."""
    label, out = np.unique(comp, return_inverse=True)[1], []
    n = np.array([len(s) for s in sets])

    def done(a: np.ndarray, b: np.ndarray) -> bool:
        x, y = label[a], label[b]
        return bool((x == x[0]).all() and (y == x[0]).all())

    for p, q in unit_pairs(side, n, [bitmap_of(s) for s in sets], np.array([s[0] for s in sets]), done):
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            if label[a] == label[b]:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if (DENOMINATOR + NUMERATOR) * common >= NUMERATOR * (n[a] + n[b]):
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def unit_candidates(side: np.ndarray, comp: np.ndarray, n: np.ndarray, bitmaps: list[bytes]) -> np.ndarray:
    """Positions of the sets that have a possible partner in another component."""
    label = np.unique(comp, return_inverse=True)[1]
    marked = np.zeros(len(n), bool)

    def done(a: np.ndarray, b: np.ndarray) -> bool:
        x, y = label[a], label[b]
        return bool(marked[a].all() and marked[b].all() or (x == x[0]).all() and (y == x[0]).all())

    for p, q in unit_pairs(side, n, bitmaps, np.array([int.from_bytes(x[:7]) for x in bitmaps]), done):
        other = label[p] != label[q]
        marked[p[other]] = marked[q[other]] = True
    return np.flatnonzero(marked)


def by_unit(rows: DataFrame, payload: list[str], schema: str, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """work over the rows of each unit (key, l, r) at once, with side, id, cls, comp and the payload; units are bounded."""
    names = ["key", "l", "r", "side", "id", "cls", "comp", *payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for t in batches:
            if not t.num_rows:
                continue
            unit = np.stack([t.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(unit[:, a].tolist())
                if held and now != last:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                last = now
                held.append(t.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    dealt = rows.select(*names).repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")
    return dealt.mapInArrow(run, schema)


def links_by_unit(rows: DataFrame) -> DataFrame:
    """Links (a, b) from rows with tokens."""

    def work(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        lists = t.column("tokens").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        found = np.array(unit_links(t.column("side").to_numpy(), t.column("comp").to_numpy(), sets), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return by_unit(rows, ["tokens"], "a bigint, b bigint", work)


def candidates_by_unit(rows: DataFrame) -> DataFrame:
    """The rows, with bitmap, that have a possible partner in another component of their unit."""
    kept = ["key", "l", "r", "side", "id", "cls", "comp"]

    def work(t: pa.Table) -> pa.Table:
        marked = unit_candidates(t.column("side").to_numpy(), t.column("comp").to_numpy(), t.column("n").to_numpy(), t.column("bitmap").to_pylist())
        return t.select(kept).take(pa.array(marked, pa.int64()))

    return by_unit(rows, ["n", "bitmap"], "key bigint, l bigint, r bigint, side bigint, id bigint, cls bigint, comp bigint", work)


def units_of(keyed: DataFrame) -> DataFrame:
    """(key, members, blocks, anchor) of keys with two classes or more; of keys with the same classes, one."""
    groups = keyed.groupBy("key").agg(
        F.min("id").alias("anchor"),
        F.max("id").alias("last"),
        F.count("*").alias("members"),
        F.sum("n").alias("size"),
        F.bit_xor("cls").alias("x"),
        F.bit_xor(F.xxhash64("cls")).alias("y"),
    )
    groups = groups.where("anchor <> last").groupBy("members", "x", "y").agg(
        F.min("key").alias("key"),
        F.first("anchor").alias("anchor"),
        F.first("size").alias("size"),
    )
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("size") / BLOCK_TOKENS))
    return groups.select("key", "members", blocks.cast("bigint").alias("blocks"), "anchor")


def first_links(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Links within the blocks of each key; the anchors of a key are in all of its blocks."""
    rows = keyed.join(units_of(keyed), "key")
    spread = F.xxhash64("cls", F.lit(3))
    everywhere = (F.col("id") == F.col("anchor")) | (F.pmod(F.xxhash64("cls", F.lit(5)), F.col("members")) < ANCHORS)
    blocks = F.when(everywhere, F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(spread, F.col("blocks"))))
    rows = checkpointed(
        rows.select(
            "key",
            F.explode(blocks).alias("l"),
            F.lit(0).cast("bigint").alias("r"),
            F.lit(2).cast("bigint").alias("side"),
            "id",
            "cls",
            F.col("id").alias("comp"),
        ),
    )
    return links_by_unit(with_sets(texts, rows))


def cut_sizes(found: DataFrame) -> DataFrame:
    """found (all, most, blocks) with left_blocks, the blocks of classes outside the main component, and the rows that a
    two-sided unit of all blocks has."""
    outside = F.col("all") - F.col("most")
    found = found.withColumn("left_blocks", F.ceil(F.col("blocks") * outside / F.col("all")))
    return found.withColumn("cost", F.col("all") * F.col("left_blocks") + outside * F.col("blocks"))


def keys_apart(rows: DataFrame, block: int, block_tokens: int) -> DataFrame:
    """(key, main, all, most, size, blocks, left_blocks, cost) of keys whose classes are in several components; main is the largest.
    rows: (key, id, cls, n, comp)."""
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("own"), F.sum("n").alias("tokens"))
    keys = counts.groupBy("key").agg(
        F.max_by("comp", F.struct("own", "comp")).alias("main"),
        F.sum("own").alias("all"),
        F.max("own").alias("most"),
        F.sum("tokens").alias("size"),
    )
    return checkpointed(cut_sizes(with_blocks(keys.where("most < all"), block, block_tokens)))


def with_blocks(sizes: DataFrame, block: int, block_tokens: int) -> DataFrame:
    return sizes.withColumn("blocks", F.greatest(F.ceil(F.col("all") / block), F.ceil(F.col("size") / block_tokens)).cast("bigint"))


def meeting(rows: DataFrame, keys: DataFrame, block: int, block_tokens: int) -> DataFrame:
    """Units (key, l, r, side, id, cls, comp, n) in which classes of different components meet.

    A key of one block is a unit. In larger ones, classes outside the key's largest component meet with all others. Keys of
    several blocks whose largest component is the same (as all keys of a group of copies) are joined as one, if the union
    of their classes makes fewer rows than the keys one by one."""
    classes = rows.join(keys, "key")
    whole = classes.where("blocks = 1").select(
        "key",
        F.lit(0).cast("bigint").alias("l"),
        F.lit(0).cast("bigint").alias("r"),
        F.lit(2).cast("bigint").alias("side"),
        "id",
        "cls",
        "comp",
        "n",
    )
    large = classes.where("blocks > 1")
    union = checkpointed(large.select("main", "id", "cls", "n", "comp").distinct())
    sizes = union.groupBy("main").agg(F.count("*").alias("all"), F.count(F.when(F.col("comp") == F.col("main"), 1)).alias("most"), F.sum("n").alias("size"))
    sizes = cut_sizes(with_blocks(sizes, block, block_tokens))
    apart = keys.where("blocks > 1").groupBy("main").agg(F.sum("cost").alias("apart"))
    sizes = checkpointed(sizes.join(apart, "main").withColumn("together", F.col("cost") < F.col("apart")))
    columns = ["key", "main", "blocks", "left_blocks", "id", "cls", "comp", "n"]
    one_by_one = large.join(sizes.where("NOT together").select("main"), "main", "left_semi").select(*columns)
    # the number of a block, of several keys as one, is negative: it is no block of a key
    together = union.join(sizes.where("together").select("main", "blocks", "left_blocks"), "main").withColumn("key", F.col("main")).select(*columns)
    spread, upto = F.xxhash64("cls", F.lit(3)), lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    place = lambda side, l, r: F.struct(F.lit(side).cast("bigint").alias("side"), l.alias("l"), r.alias("r"))  # noqa: E731, E741
    right = F.transform(upto(F.col("left_blocks")), lambda l: place(1, l, F.pmod(spread, F.col("blocks"))))  # noqa: E741
    left = F.transform(upto(F.col("blocks")), lambda r: place(0, F.pmod(spread, F.col("left_blocks")), r))
    places = F.when(F.col("comp") == F.col("main"), right).otherwise(F.concat(left, right))
    cut = one_by_one.withColumn("kind", F.lit(0)).unionByName(together.withColumn("kind", F.lit(1)))
    cut = cut.select("key", "id", "cls", "comp", "n", "kind", F.explode(places).alias("p"))
    cut = cut.select("key", F.when(F.col("kind") == 0, F.col("p.l")).otherwise(-1 - F.col("p.l")).alias("l"), "p.r", "p.side", "id", "cls", "comp", "n")
    return whole.unionByName(cut)


def second_links(texts: DataFrame, keyed: DataFrame, labels: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Links between the components (labels: node, component) that meet under some key. Of keys that need several blocks, only
    classes that have a possible partner by their bitmaps, in coarse units, are cut into blocks."""
    rows = keyed.join(units_of(keyed), "key").join(labels, keyed["id"] == labels["node"], "left")
    rows = checkpointed(rows.select("key", "id", "cls", "n", F.coalesce("component", "id").alias("comp")))
    keys = keys_apart(rows, BLOCK, BLOCK_TOKENS)
    large = keys.where("blocks > 1").select("key")
    if not large.isEmpty():
        of_large = rows.join(large, "key", "left_semi")
        coarse = meeting(of_large, keys_apart(of_large, COARSE, COARSE_TOKENS), COARSE, COARSE_TOKENS)
        marked = checkpointed(candidates_by_unit(coarse.join(bitmaps, ["id", "cls"])).select("id", "cls").distinct())
        rows = rows.join(keys.where("blocks = 1").select("key"), "key", "left_semi").unionByName(of_large.join(marked, ["id", "cls"], "left_semi").select(*rows.columns))
        rows = checkpointed(rows)
        keys = keys_apart(rows, BLOCK, BLOCK_TOKENS)
    found = candidates_by_unit(meeting(rows, keys, BLOCK, BLOCK_TOKENS).join(bitmaps, ["id", "cls"]))
    return links_by_unit(with_sets(texts, checkpointed(found)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = long_text(docs, id_col, text_col).toDF("doc_id", "text")
    first = checkpointed(sizes_and_frequent(texts))
    rows = first.where("token IS NULL").select("doc_id", "n", "sig")
    hot = hot_tokens(first.where("token IS NOT NULL").select("token", "found"))
    named = rows.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("id"))
    named = checkpointed(named)
    keys = class_keys(texts, hot)
    named_by = named.select(F.col("sig").alias("s"), F.col("id").alias("i"))
    keys = keys.join(named_by, (keys["sig"] == F.col("s")) & (keys["doc_id"] == F.col("i")), "left_semi").dropDuplicates(["sig", "doc_id"])
    keys = checkpointed(keys.select(F.col("doc_id").alias("id"), F.xxhash64("sig").alias("cls"), "n", "keys", "n_own", "bitmap"))
    keyed = keys.select("id", "cls", "n", "n_own", F.posexplode("keys").alias("place", "key"))
    first = keyed.where(F.when(F.col("place") < F.col("n_own"), F.col("place")).otherwise(F.col("place") - F.col("n_own")) < FIRST)
    links = checkpointed(first_links(texts, first.select("key", "id", "cls", "n")))
    labels = components(links)
    more = checkpointed(second_links(texts, keyed.select("key", "id", "cls", "n"), labels, keys.select("id", "cls", "bitmap")))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    final = checkpointed(named.join(labels, named["id"] == labels["node"], "left").select("sig", F.coalesce("component", "id").alias("component_id")))
    with_set = rows.where("sig IS NOT NULL").join(final, "sig", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    without = rows.where("sig IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their class of near-duplicates (smallest doc_id), with their columns. Of rows equal in
    all columns one stays; rows that share a doc_id but differ are one document and stay, as do rows without a doc_id."""
    gone = checkpointed(near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id")).distinct())
    few = gone.limit(IDS_MOST + 1).count() <= IDS_MOST
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
    repeated = checkpointed(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__again_id")))
    if repeated.isEmpty():
        return kept
    again = kept["doc_id"] == repeated["__again_id"]
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates())


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard": op10_jaccard}

ORACLE_SQL = {
    "op10_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) m USING (doc_id)"""
}
