"""Best-fit packing: documents to token sequences of fixed length by a bounded-space online best fit.

Each task keeps at most OPEN bins open; a bit of one integer says for each free space whether an open bin has it, so the
tightest fit is one shift and one lowest bit. When all bins are in use the fullest closes. The pieces in bins that a task
leaves open are packed again by a second round of the same packing, the longest first, FOLD tasks' pieces at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import tokenizer

OPEN, FOLD, OPEN_AGAIN = 256, 32, 4096
#: Bins of a task are numbered from task << TASK_BITS on.
TASK_BITS = 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, full boolean"


class Packer:
    """put() tells the bin and the place in it; closed() and left() give the bins that were closed since, and those still open."""

    def __init__(self, size: int, most_open: int, first: int = 0):
        self.size, self.most, self.next = size, most_open, first
        self.bits, self.by_free, self.n_open, self.done = 0, [[] for _ in range(size + 1)], 0, []

    def _take(self, free: int) -> int:
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open >= self.most:
                self.done.append(self._take((self.bits & -self.bits).bit_length() - 1))
            b, free = self.next, self.size
            self.next += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(b)
            self.bits |= 1 << rest
            self.n_open += 1
        else:
            self.done.append(b)
        return b, self.size - free

    def closed(self) -> list[int]:
        out, self.done = self.done, []
        return out

    def left(self) -> list[int]:
        return [b for bins in self.by_free for b in bins]


def _pack(file: str, end_id: int, size: int, most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release(keep_words=True)
        t, packer, end = tokenizer(file), None, np.array([end_id], "<u4").tobytes()
        held: dict[int, list[tuple]] = {}

        def rows(bins: list[int], full: bool) -> pa.RecordBatch:
            x = [(*row[:5], b, row[5], full) for b in bins for row in held.pop(b)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "full")
            return common.table(**{k: pa.array(v, kind) for k, v, kind in zip(names, zip(*x, strict=True) if x else [[]] * 8, kinds, strict=True)})

        for batch in batches:
            if packer is None:
                packer = Packer(size, most_open, batch.column(0)[0].as_py() << TASK_BITS)
            for doc, ids in zip(batch.column(1).to_pylist(), t.ids(batch.column(2)), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    b, place = packer.put(len(part) // 4)
                    held.setdefault(b, []).append((doc, k, a // 4, len(part) // 4, zlib.crc32(part), place))
            yield rows(packer.closed(), True)
        if packer is not None:
            yield rows(packer.left(), False)

    return run


def _fold(size: int, most_open: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The second round; its input has a bound: FOLD tasks' open bins, each of size tokens at most."""

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        lengths, bins, places = (pieces[k].to_numpy() for k in ("length", "bin", "place"))
        order, packer = np.lexsort((places, bins, -lengths)), Packer(size, most_open)
        put = np.array([packer.put(n) for n in lengths[order].tolist()], np.int64).reshape(-1, 2)
        first = (1 << 62) + (key[0].as_py() << TASK_BITS - 8)
        return pa.table({"bin": bins[order], "place": places[order], "sequence": first + put[:, 0], "base": put[:, 1]})

    return run


def pack(docs: DataFrame, file: str, size: int = 2048, end_id: int = 0, most_open: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and the end id; only those longer than size are cut. Null text is empty, so its one piece is the
    end id; null ids and repeated rows are packed like others. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    common.tune(spark)
    rows = common.two(docs, id_col, text_col).select(F.spark_partition_id().alias("task"), "id", "text")
    made = common.save(rows.mapInArrow(_pack(file, end_id, size, most_open), PIECES))
    fold = F.floor(F.shiftright("bin", TASK_BITS) / FOLD).cast("long").alias("fold")
    folded = made.filter("not full").select(fold, "bin", "place", "length").groupBy("fold").applyInArrow(_fold(size, OPEN_AGAIN), "bin long, place long, sequence long, base long")
    shared = ["doc_id", "piece", "start", "length", "ids_crc32"]
    over = made.filter("not full").join(folded, ["bin", "place"]).select(*shared, F.col("sequence").alias("sequence_id"), F.col("base").alias("offset"))
    return made.filter("full").select(*shared, F.col("bin").alias("sequence_id"), F.col("place").alias("offset")).unionByName(over)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
