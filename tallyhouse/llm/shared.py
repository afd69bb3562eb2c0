"""Arrow plumbing, shared storage and vectorised byte hashing used by several operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Python call handles at once; long texts are further split by bytes.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Bytes of an Arrow batch that a task hands to Python; each batch lies in the JVM and in the worker, outside the heap.
BATCH_BYTES = 4 << 20


def as_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of a column; null is the empty text, invalid UTF-8 is replaced."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The same of a column without nulls, faster for many short strings."""
    try:
        return column.to_numpy(zero_copy_only=False).tolist()
    except UnicodeDecodeError:
        return as_texts(column)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, by: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch, none with many more than SLICE_BYTES bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


#: What workers remember from task to task, by operator.
_held: list = []


def held(size: int) -> Callable:
    """lru_cache of what a worker holds between tasks that declare it; in_arrow's other tasks drop it."""

    def wrap(make: Callable) -> Callable:
        _held.append(lru_cache(maxsize=size)(make))
        return _held[-1]

    return wrap


def give_back(*stay: Callable) -> None:
    """Drop what held() functions other than these remember, and return freed memory to the system; idle workers count too."""
    for cache in _held:
        if not any(cache is x for x in stay) and cache.cache_info().currsize:
            cache.cache_clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the latter trims what C libraries and numpy have freed
        pool.release_unused()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, *stay: Callable) -> DataFrame:
    """mapInArrow with batches of about BATCH_BYTES, one row at least, by workers that hold nothing from earlier tasks but the held() functions in stay.

    The limit is a setting of the session, read when a plan runs, so it stays with the session; a lower one is left.
    """
    spark = df.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(*stay)
        yield from run(batches)
        give_back(*stay)

    return df.mapInArrow(task, schema)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, by: str = "text") -> DataFrame:
    """mapInArrow with one call of work for each slice; work returns columns in the order of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kinds = _parse_datatype_string(schema)
    assert isinstance(kinds, StructType)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by):
                out = work(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out.values(), arrow, strict=True)], schema=arrow)

    return in_arrow(df, run, kinds)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, else its checkpoint folder; one of our own for local runs alone."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    there = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not there:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = "/tmp/checkpoints"
    if held.isEmpty():
        context.setCheckpointDir(there)
    return there


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as Parquet and read back, which cuts lineage and survives lost executors. The files go by release(), else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of kept DataFrames that nothing is read from any more."""
    for df in frames:
        held = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept)
        held.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(held, True)


def row_key(*more: str) -> "F.Column":
    """A 64-bit key of a document's id and whole text; equal rows share it."""
    return F.xxhash64("doc_id", "text", *more)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def eights(text: bytes) -> np.ndarray:
    """The eight bytes from each place of text on as one number, little-endian; zeros follow the text."""
    return np.ndarray(len(text), "<u8", text + bytes(8), strides=(1,))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 0x09 to 0x0D."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    turns = np.flatnonzero(np.diff(inside))
    return turns[::2], turns[1::2]


#: Words longer than this are hashed one by one.
LONG_WORD = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of text, in order. Each eight bytes are mixed into what came before, so no algebra of bases and places makes different words equal."""
    start, end = word_bounds(np.frombuffer(text, np.uint8))
    size = end - start
    at = eights(text)
    with np.errstate(over="ignore"):
        out = mixed(mixed(at[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64))
        more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        done = 8
        while len(more):
            left = size[more] - done
            out[more] = mixed(out[more] * np.uint64(0x9FB21C651E98DF25) + mixed(at[start[more] + done] & _FIRST[np.minimum(left, 8)]))
            done += 8
            more = more[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive words."""
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k])
        return out
