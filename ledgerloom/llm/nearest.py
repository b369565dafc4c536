"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Vectors are dealt to lists around k-means centres (Euclidean, after one more coordinate has made all norms alike, so that
the largest inner product is the nearest vector). A query probes the lists of its nearest centres. Within a list, vectors
are rotated by a fixed random orthogonal matrix and scanned in blocks of columns: after each block, a hypothesis test on
the partial distance abandons candidates that are too far with high confidence (the share of a distance that some rotated
columns hold follows a Beta distribution); the others go on. What is left is
measured exactly, on the original vectors in double precision.

A query's threshold is its k-th best inner product with a bounded sample's vectors in the lists it probes: a bound for
the k-th best there. A query that finds fewer than k is searched again in all lists without tests. Centres, the number of probes and the sample come from at most SAMPLE vectors, by a hash of their id;
the number of probes is what reaches RECALL of the sample's own neighbours. Every vector is indexed.

Lists are cut into segments of about SEGMENT rows and their queries into blocks of about QUERY_BLOCK, so no list, however
large, meets in one task. The rows of a unit (list, segment, block) are bounded; each gives at most k rows a query.

Vectors that are null, zero, hold null or non-finite components, have no id, or differ in length from most vectors take
no part. Of query rows that share an id one counts (the smallest vector); rows with the query's id are no candidates for
it. Other repeated rows are candidates each. Ties go to the smaller id. An empty table, or one without a query, gives an empty
result. Only id and vector are read, so other columns may have any name.

How many lists hold a query's neighbours is up to the data: where vectors hardly cluster, most lists are probed to reach RECALL, and
work for each query grows with the table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_object, checkpointed, hash_sample, table

K, QUERY_EVERY = 20, 20
SAMPLE, LISTS_MOST = 16_384, 4096
#: Vectors of the sample that give a query's first threshold.
FIRST = 4096
SEGMENT, QUERY_BLOCK = 512, 512
RECALL = 0.97
BLOCK = 16
#: How many standard deviations a partial distance may be over the threshold.
EPSILON = 2.5
#: Pairs are followed one by one once fewer than one in so many live.
SPARSE = 50
SEED = 5


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of usable vectors: v holds the components as float32 if the column is of floats, else float64."""
    kind = "float32" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "float64"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ids, out = [], []
            for i, x in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(kind)
                if len(v) and np.isfinite(v).all() and v.any():
                    ids.append(i)
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    found = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].alias("v")).mapInArrow(run, "id bigint, v binary")
    return found.withColumn("dim", (F.octet_length("v") / (4 if kind == "float32" else 8)).cast("int"))


def stacked(column: pa.Array | list, dim: int) -> np.ndarray:
    raw = column if isinstance(column, list) else column.to_pylist()
    if not raw:
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * dim else np.float64).reshape(-1, dim).astype(np.float64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T


class Index:
    """Centres, probes, rotation and the first sample, as plain arrays; fitted on a bounded sample."""

    def __init__(self, x: np.ndarray, total: int, largest: float, k: int) -> None:
        self.dim, self.k, self.largest = x.shape[1], k, largest
        rng = np.random.default_rng(SEED)
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        self.first = x[:FIRST]
        y = self.raised(x)
        lists = int(min(LISTS_MOST, max(1, round(total**0.5)), len(np.unique(y.round(9), axis=0)), max(1, len(x) // 8)))
        c = y[rng.choice(len(y), lists, replace=False)]
        for _ in range(12):
            near = self._nearest(y, c)
            sums = np.zeros_like(c)
            np.add.at(sums, near, y)
            counts = np.bincount(near, minlength=len(c))
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        self.centres = c
        self.first_lists = self._nearest(y[:FIRST], c)
        # probes: ranks of the lists that hold the sample's own neighbours
        asked = rng.choice(len(x), min(len(x), 400), replace=False)
        ip = x[asked] @ x.T
        ip[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-ip, min(k, len(x) - 1) - (len(x) <= k), axis=1)[:, : min(k, len(x) - 1)]
        rank = np.argsort(np.argsort(squared(self.lowered(x[asked]), c), axis=1, kind="stable"), axis=1, kind="stable")
        near = self._nearest(y, c)
        ranks = np.sort(np.take_along_axis(rank, near[best], axis=1).ravel())
        self.probes = int(ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))]) + 1 if len(ranks) else len(c)

    @staticmethod
    def _nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([squared(y[i : i + 4096], c).argmin(axis=1) for i in range(0, len(y), 4096)]) if len(y) else np.zeros(0, int)

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.largest - (x**2).sum(1)))[:, None]])

    def lowered(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))])

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.raised(x), self.centres)

    def probed(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(squared(self.lowered(q), self.centres), axis=1, kind="stable")[:, : self.probes]

    def thresholds(self, q: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """A bound for each query's k-th best inner product in the lists that it probes, from the sample's vectors there:
        of k + 1, since the query may be one of them."""
        ip = q @ self.first.T
        if ip.shape[1] <= self.k:
            return np.full(len(q), -np.inf)
        asked = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(asked, probed, True, axis=1)
        ip[~asked[:, self.first_lists]] = -np.inf
        return np.partition(ip, ip.shape[1] - self.k - 1, axis=1)[:, ip.shape[1] - self.k - 1] - 1e-9

    def scan(self, q: np.ndarray, tau: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, candidate) that the tests leave. While many pairs live, a block of columns is one matrix product
        over all of them, less the candidates that are dead for every query; then it is a product for each pair."""
        qr, xr = q @ self.rotation, x @ self.rotation
        limit = (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * tau[:, None]  # of the squared distance
        part, alive, own = np.zeros_like(limit), np.ones(limit.shape, bool), np.arange(len(x))
        a = b = None
        for d0 in range(0, self.dim, BLOCK):
            d1 = min(d0 + BLOCK, self.dim)
            share = most_share(d1, self.dim)
            if a is None:
                part += np.maximum(squared(qr[:, d0:d1], xr[:, d0:d1]), 0)
                alive &= part <= limit * share * (1 + 1e-9) + 1e-9
                kept = alive.any(axis=0)
                if 2 * kept.sum() < len(kept):
                    part, limit, alive, xr, own = part[:, kept], limit[:, kept], alive[:, kept], xr[kept], own[kept]
                if d1 < self.dim and alive.sum() * SPARSE < alive.size:
                    a, b = np.nonzero(alive)
                    part, limit = part[a, b], limit[a, b]
            else:
                part = part + ((qr[a, d0:d1] - xr[b, d0:d1]) ** 2).sum(1)
                keep = part <= limit * share * (1 + 1e-9) + 1e-9
                a, b, part, limit = a[keep], b[keep], part[keep], limit[keep]
        if a is None:
            a, b = np.nonzero(alive)
        return a, own[b]


def most_share(d: int, dim: int) -> float:
    """The share of a squared distance that d of dim randomly rotated columns hold at most: mean and deviation of the
    Beta(d / 2, (dim - d) / 2) distribution, EPSILON deviations up."""
    f = d / dim
    return min(1.0, f + EPSILON * (2 * f * (1 - f) / (dim + 2)) ** 0.5)


def fitted(found: DataFrame, total: int, dim: int, k: int) -> Index:
    rows = sorted(hash_sample(found.select("id", "v"), "id", total, SAMPLE).collect(), key=lambda r: (r["id"], bytes(r["v"])))
    x = stacked([bytes(r["v"]) for r in rows], dim)
    order = np.random.default_rng(SEED).permutation(len(x))
    largest = found.agg(F.max("norm2")).first()[0]
    return Index(x[order], total, float(largest), k)


def nearest(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row. is_query: a condition on column id."""
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    found = vectors(rows, id_col, vector_col)
    dims = found.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, total = dims

    def with_norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays(
                [t.column(0), t.column(1), pa.array((stacked(t.column(1), dim) ** 2).sum(1), pa.float64())],
                names=["id", "v", "norm2"],
            )

    found = checkpointed(found.where(F.col("dim") == dim).select("id", "v").mapInArrow(with_norm, "id bigint, v binary, norm2 double"))
    index = fitted(found, total, dim, k)
    kept = broadcast_object(spark, index)

    def load() -> Index:
        return pickle.loads(kept.value)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load()
        for t in batches:
            if t.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [t.column(0), t.column(1), pa.array(index.lists_of(stacked(t.column(1), dim)), pa.int32())],
                    names=["id", "v", "list"],
                )

    def probing(every_list: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = load()
            for t in batches:
                for at in range(0, t.num_rows, 512):
                    part = t.slice(at, 512)
                    q = stacked(part.column(1), dim)
                    lists = np.tile(np.arange(len(index.centres)), (len(q), 1)) if every_list else index.probed(q)
                    tau = np.full(len(q), -np.inf) if every_list else index.thresholds(q, lists)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(tau), pa.array(lists.tolist(), pa.list_(pa.int32()))],
                        names=["id", "v", "tau", "lists"],
                    )

        return run

    dealt = checkpointed(found.select("id", "v").mapInArrow(listed, "id bigint, v binary, list int"))
    # lists are cut by their sizes: as many numbers as there are lists come to the driver
    sizes = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}

    def measured(group: pa.Table) -> pa.Table:
        index = load()
        names = ["query_id", "vec_id", "score"]
        side = group.column("side").to_numpy()
        ids, tau = group.column("id").to_numpy(), group.column("tau").to_numpy()
        all_v = stacked(group.column("v").combine_chunks(), dim)
        order = np.lexsort((ids, side))
        side, ids, tau, all_v = side[order], ids[order], tau[order], all_v[order]
        x, q = all_v[side == 0], all_v[side == 1]
        x_ids, q_ids, tau = ids[side == 0], ids[side == 1], tau[side == 1]
        out: list[list[np.ndarray]] = [[], [], []]
        if len(x) and len(q):
            for at in range(0, len(q), 128):
                a, b = index.scan(q[at : at + 128], tau[at : at + 128], x)
                a = a + at
                other = q_ids[a] != x_ids[b]
                a, b = a[other], b[other]
                score = (q[a] * x[b]).sum(axis=1)
                by = np.lexsort((x_ids[b], -score, a))
                a, b, score = a[by], b[by], score[by]
                place = np.arange(len(a)) - np.searchsorted(a, a, "left")
                top = place < k
                for column, values in zip(out, (q_ids[a[top]], x_ids[b[top]], score[top]), strict=True):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, t) for n, c, t in zip(names, out, kinds, strict=True)})

    def searched(queries: DataFrame, every_list: bool) -> DataFrame:
        asked = checkpointed(queries.select("id", "v").mapInArrow(probing(every_list), "id bigint, v binary, tau double, lists array<int>"))
        probes = {r["list"]: r["count"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}
        cuts = [(i, -(-n // SEGMENT), -(-probes[i] // QUERY_BLOCK)) for i, n in sizes.items() if i in probes]
        cut = F.broadcast(spark.createDataFrame(cuts, "list int, segments int, blocks int"))  # LISTS_MOST rows at most
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        spread = F.xxhash64("id", F.lit(3))
        candidates = dealt.join(cut, "list").withColumn("segment", F.pmod(spread, F.col("segments")).cast("int")).withColumn("block", upto("blocks")).select(
            "list",
            "segment",
            "block",
            F.lit(0).alias("side"),
            "id",
            "v",
            F.lit(0.0).alias("tau"),
        )
        seekers = asked.select("id", "v", "tau", F.explode("lists").alias("list")).join(cut, "list").withColumn("block", F.pmod(spread, F.col("blocks")).cast("int")).withColumn("segment", upto("segments")).select(
            "list",
            "segment",
            "block",
            F.lit(1).alias("side"),
            "id",
            "v",
            "tau",
        )
        near = candidates.unionByName(seekers).groupBy("list", "segment", "block").applyInArrow(measured, "query_id bigint, vec_id bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return checkpointed(
            near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
                "query_id",
                F.col("rank").cast("int").alias("rank"),
                "vec_id",
                "score",
            ),
        )

    queries = found.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    if queries.isEmpty():
        return spark.createDataFrame([], schema)
    near = searched(queries, every_list=False)
    # a query that found fewer than k (a test abandoned too many, or its lists are short) is searched in full
    full = near.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = checkpointed(queries.join(full, "id", "left_anti"))
    if short.isEmpty():
        return near
    again = searched(short, every_list=True)
    return near.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % QUERY_EVERY == 0)


QUERIES = {"op5_nearest": op5_nearest}
ORACLE_SQL: dict[str, str] = {}
