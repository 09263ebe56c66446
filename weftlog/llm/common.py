"""What the operators share: scratch tables on the shared folder, zero-copy access to text columns, word hashing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the ASCII controls from tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Arrow batches: few enough rows and bytes that the buffers of the JVM and of a worker, which keep their largest size, stay small.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes; kept as they are where the session already has smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in str(now or "") if c.isdigit())
        if not digits or not 0 < int(digits) <= most or str(now)[-1].isalpha():
            spark.conf.set(key, str(most))


def parts(spark: SparkSession, size: int, each: int) -> int:
    """How many partitions a shuffle of so many rows (or bytes) takes: the session's number, and more where one would get more than `each`."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset a temporary one, if all of Spark runs in this one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/weftlog/{uuid.uuid4().hex}"


def save(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: later stages start from files, not from lineage."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def settle(spark: SparkSession) -> None:
    """Has the shuffle files of finished jobs deleted: Spark does that when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*saved: DataFrame) -> None:
    """Deletes saved tables that nothing will read again."""
    for df in saved:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def two(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (as string), so that other columns, whatever their names, cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def release(keep_words: bool = False) -> None:
    """At the start of a task: drops what the worker's earlier tasks keep, and gives free memory back.

    Arrow takes its buffers from the C library from then on, whose free memory can be given back.
    """
    if (tokens := sys.modules.get(f"{__package__}.tokens")) and not keep_words:
        tokens.forget()
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after another, and the n + 1 offsets of the rows. Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words under `[^\x20\x09-\x0D]+`.
WORD = ~byte_class(SPACES)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of mask within each row, and the first run's index of each row (n + 1)."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, mask[:-1], False, mask[1:]
    before[offs[:-1][offs[:-1] < n]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one integer; reading beyond the end gives zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


LONG_WORD = 512


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    view = loads(data)
    for i in range(0, len(starts), WORDS_AT_ONCE):  # few at once stay in the cache
        part = slice(i, i + WORDS_AT_ONCE)
        out[part] = _hash_some(data, view, starts[part], ends[part])
    return out


WORDS_AT_ONCE = 1 << 16


def _hash_some(data: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * C1)
    long = size > LONG_WORD
    todo = np.flatnonzero(~long)
    at, left = starts[todo], size[todo]
    while len(todo):
        keep = np.minimum(left, 8).astype(np.uint64)
        part = view[at] & (~np.uint64(0) >> ((np.uint64(8) - keep) * np.uint64(8)))
        out[todo] = mix(out[todo] * C1 ^ part)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(long):
        out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return out


def slices(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """The column in parts of about so many bytes."""
    parts = max(1, -(-column.nbytes // most))
    step = max(1, -(-len(column) // parts))
    for i in range(0, len(column), step):
        yield column.slice(i, step)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive word hashes from each place on (len(words) - n + 1 of them)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = mix(words[: len(words) - n + 1] + np.uint64(n * int(C1) & (1 << 64) - 1))
    for k in range(1, n):
        out = out * C1 ^ words[k : len(words) - n + 1 + k]
        out = mix(out) if k == n - 1 else out ^ (out >> np.uint64(29))
    return out


def in_row(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the n words from each place on lie in one row; first: the first word's index of each row (and the end)."""
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        cut = first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def rebatch(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Joins small Arrow batches up to about so many bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
