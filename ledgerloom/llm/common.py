"""Pieces that the operators share: Arrow row scans, word splitting, checkpoints, deterministic samples."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that are handled at once; bounds a worker's memory beside the batch itself.
SLICE_ROWS = 512

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "double": pa.float64(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
}

#: ASCII bytes other than letters and digits become blanks, capitals become small letters; all other bytes stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Only A-Z change.
_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def blank_words_of(text: str | None) -> list[bytes]:
    """Words between blanks (space, tab, LF, VT, FF, CR), A-Z in lower case, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split()


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in spec.split(",")]


def scan(rows: DataFrame, schema: str, factory: Callable[[], Callable]) -> DataFrame:
    """One output row for each input row. factory() runs once in each task and returns a function that takes an
    input row's values and returns the output row's values."""
    out = pa.schema([(name, _ARROW[kind]) for name, kind in columns(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = [work(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)


def scan_many(rows: DataFrame, schema: str, factory: Callable[[], Callable]) -> DataFrame:
    """factory() runs once in each task and returns a function from an iterator of rows (tuples) to an iterator of
    column lists; each is one output batch."""
    out = pa.schema([(name, _ARROW[kind]) for name, kind in columns(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True)

        for cols in factory()(each()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, kept in the folder that spark.checkpoint.dir names and all executors share."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def use_small_batches(spark: SparkSession, rows: int = SLICE_ROWS) -> None:
    """From now on Arrow batches of the session hold so many rows at most, so long texts need little memory."""
    spark.conf.set(BATCH_ROWS, rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = SLICE_ROWS) -> Iterator[None]:
    """While it is open, Arrow batches hold so many rows at most: for scans that run in it, beside large shuffles."""
    before = spark.conf.get(BATCH_ROWS)
    use_small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def hash_sample(df: DataFrame, key: str, total: int, wanted: int, seed: int = 17) -> DataFrame:
    """About `wanted` of `total` rows, by a hash of the key: the same rows whatever the partitioning."""
    if total <= wanted:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < F.lit(int((1 << 40) * wanted / total)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that a scan reads; other columns, whatever their names, are pruned from the read."""
    return docs.select(docs[id_col].cast(T.LongType()).alias(id_col), docs[text_col].alias(text_col))


def text_column(kind: T.DataType, make: Callable[[], Callable[[list], list]]):
    """A column function: make() runs once in each task and returns a function from a list of texts to a list of values.
    Marked as not deterministic, so that a filter on it isn't pushed below its column and evaluated a second time."""
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}[kind.simpleString()]

    @F.arrow_udf(kind)
    def column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in texts:
            made = []
            for at in range(0, len(batch), SLICE_ROWS):
                made += work(batch.slice(at, SLICE_ROWS).to_pylist())
            yield pa.array(made, arrow)

    return column.asNondeterministic()


def broadcast_object(spark: SparkSession, value: object):
    """A broadcast of the value's pickle, with its class, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; with a local master, as in tests, a temporary one where none
    is set."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def stage_written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
