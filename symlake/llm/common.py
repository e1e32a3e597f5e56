"""What the operators share: the shared folder, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(name: str, taken: Iterable[str]) -> str:
    """name behind underscores, so that no column of a table (taken) is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


# --- shared folder -------------------------------------------------------------------------------


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (URI) under spark.checkpoint.dir that driver and executors see, removed when the driver's JVM ends.

    A folder of this machine is used only where that setting is empty and Spark runs on this machine alone.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "symlake-shared")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def drop_dir(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced.

    Twice, as a plan that has just ended is still known to the listeners for a moment.
    """
    for pause in (0.3, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def table(spark: SparkSession, df: DataFrame, uri: str, small: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet under uri and read it again; small: there are no shuffles worth freeing."""
    df.write.mode("overwrite").parquet(uri)
    if not small:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(uri)


def fs_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a Hadoop URI; Hadoop writes file:/x for file:///x, and s3a for s3."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    scheme, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def write_shards(spark: SparkSession, df: DataFrame, key: list[str], uri: str, rows_per_shard: int, ordered: bool = False) -> list[str]:
    """Write df as Parquet files of about rows_per_shard rows each, dealt by key (ordered: sorted by it); return their URIs."""
    n = df.count()
    if not n:
        return []
    out = df.repartition(max(1, -(-n // rows_per_shard)), *key)
    if ordered:
        out = out.sortWithinPartitions(*key)
    out.write.mode("overwrite").parquet(uri)
    return sorted(spark.read.schema(df.schema).parquet(uri).inputFiles())


def read_shard(uri: str) -> pa.Table:
    fs, path = fs_of(uri)
    with fs.open_input_file(path) as f:
        return pq.read_table(f)


# --- tasks ---------------------------------------------------------------------------------------


def trim() -> None:
    """Give the memory that this process no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim is not None:  # glibc
        malloc_trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which its worker gives the memory that it no longer uses back to the machine."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


# --- Arrow text ----------------------------------------------------------------------------------


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and len + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_binary(col.type) and not pa.types.is_string(col.type):
        col, wide = col.cast(pa.large_string()), True
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most limit bytes of text (or one row), their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = raw(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def _byte_table(separators: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in separators]] = True
    return t


#: Separators of [^\x20\x09-\x0D]+ words.
SPACES = _byte_table(" \t\n\r\x0b\x0c")
#: Separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ words, for text whose A-Z are already lower case.
NOT_ALNUM = ~_byte_table("0123456789abcdefghijklmnopqrstuvwxyz")
NOT_ALNUM[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in data, and the row, of all words; a word ends with its row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = np.zeros(n + 2, bool)
    w[1:-1] = ~separators[data]
    edge = off[(off > 0) & (off < n)]
    first = w[1:-1] & ~w[:-2]
    last = w[1:-1] & ~w[2:]
    first[edge] = w[1:-1][edge]
    last[edge - 1] = w[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off[1:], starts, "right")


# --- hashes --------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 in and out."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * _MUL)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        m = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _MUL), ("down", _INV)):
            a = np.full(m, base, U64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U64)
        have = _powers["up"]
    return have[:n], _powers["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, the same wherever the span lies."""
    n = len(values)
    up, down = _power(n + 1)
    c = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=c[1:])
    h = (c[ends] - c[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_VALUE[data], starts, ends)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k successive values, as span_hashes gives them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _power(len(values) + 1)
    c = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=c[1:])
    h = c[k:] - c[:-k]
    h *= down[:n]
    h += U64(k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix(h)


def order_id(col: pa.Array) -> np.ndarray:
    """Ids as int64, null last."""
    return col.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
