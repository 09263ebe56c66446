"""Token-ID / binary output: documents to files of entropy-coded token ids, and back."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, rans
from .tokens import tokenizer, vocabulary_size

TOKENIZED = "shard int, doc_id long, before long, n long, ids binary, counts binary"
BLOCKS = "shard int, before long, doc_ids array<bigint>, lengths binary, n_tokens long, lanes int, mark_steps array<int>, mark_words array<int>, mark_states binary, payload binary, crc32 long"
#: Bytes of words that a worker keeps; tokenization is most of this operator's work. An executor has a worker or two for each core.
WORDS = 128 << 20
#: Documents in one shard, about, where there are more than the session's shuffle partitions hold.
SHARD = 250_000
#: A block is closed when it has so many tokens; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 20


def _tokenize(file: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release(keep_words=True)
        t = tokenizer(file, WORDS)
        shard = before = None
        for batch in batches:
            found, offs = t.flat(batch.column(2))
            offs += np.arange(len(offs))  # each document before has one end id
            ids = np.full(offs[-1], end_id, width)
            own = np.ones(len(ids), bool)
            own[offs[1:] - 1] = False
            ids[own] = found
            sizes, n = np.diff(offs), batch.num_rows
            if shard is None and n:
                shard, before = batch.column(0)[0].as_py(), 0
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            counts = np.bincount(ids).astype("<i8")
            raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            # how often each id occurs in the batch stands in a column of its own, in the batch's first row
            yield common.table(shard=pa.array([shard] * n, pa.int32()), doc_id=batch.column(1), before=starts, n=sizes, ids=raw, counts=pa.array([counts.tobytes()] + [None] * (n - 1) if n else [], pa.binary()))

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            c = np.frombuffer(raw, "<i8")
            total = np.concatenate([total, np.zeros(max(0, len(c) - len(total)), np.int64)])
            total[: len(c)] += c
    at = np.flatnonzero(total)
    yield common.table(token=at.astype(np.int64), n=total[at])


def _encode(freq: np.ndarray, bits: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size, due = rans.Coder(freq, bits), [], 0, None

        def block() -> pa.RecordBatch:
            shard, before = held[0][0], held[0][2]
            x = coder.encode(np.frombuffer(b"".join(h[4] for h in held), width))
            row = {"shard": pa.array([shard], pa.int32()), "before": [before], "doc_ids": pa.array([[h[1] for h in held]], pa.list_(pa.int64())), "lengths": pa.array([np.array([h[3] for h in held], "<u8").tobytes()], pa.binary())}
            row |= {"n_tokens": [x["n_tokens"]], "lanes": pa.array([x["lanes"]], pa.int32())} | {k: pa.array([x[k]], pa.list_(pa.int32())) for k in ("mark_steps", "mark_words")} | {k: pa.array([x[k]], pa.binary()) for k in ("mark_states", "payload")}
            return common.table(**row, crc32=[x["crc32"]])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size >= BLOCK_TOKENS or (row[0], row[2]) != due):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += row[3]
                due = (row[0], row[2] + row[3])
        if held:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes three tables under path: `blocks` (the coded ids in ascending order of document), `table` (the shared
    frequencies) and `shards` (how many ids stand before each shard).

    Null text is empty (its ids are the end id alone), a null id sorts first, repeated rows are kept one by one, ties of the
    id are ordered by a hash of the text. An empty table gives empty files. Other columns of docs play no part.
    """
    spark = docs.sparkSession
    common.tune(spark)
    width = "<u2" if vocabulary_size(file) <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = common.two(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    n = common.parts(spark, rows.count(), SHARD)
    ranged = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), "id", "text")
    made = common.save(ranged.mapInArrow(_tokenize(file, end_id, width), TOKENIZED), f"{path}/tokenized")
    counts = made.select("counts").filter("counts is not null").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").collect()  # a row for each id of the vocabulary at most
    bits = max(16, math.ceil(math.log2(max(2, len(counts)))) + 2)
    freq = rans.quantize([r.token for r in counts], [r.n for r in counts], bits)
    made.drop("counts").mapInArrow(_encode(freq, bits, width), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(i), int(f), bits) for i, f in enumerate(freq) if f], "token int, freq long, bits int").coalesce(1).write.parquet(f"{path}/table")
    shards = made.groupBy("shard").agg(F.sum("n").alias("n"))  # a row for each partition of the sort
    shards.withColumn("shard_start", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["shard_start"]).write.parquet(f"{path}/shards")


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    """The blocks with the number of ids before each, the frequencies, and their bits."""
    rows = spark.read.parquet(f"{path}/table").collect()  # the vocabulary's size at most
    bits = rows[0].bits if rows else 16
    freq = np.zeros(max((r.token for r in rows), default=0) + 1, np.uint64)
    for r in rows:
        freq[r.token] = r.freq
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/shards").select("shard", "shard_start"), "shard")
    return blocks.withColumn("start", F.col("shard_start") + F.col("before")).drop("shard_start", "before", "shard"), freq, bits


def _decode(freq: np.ndarray, bits: int, names: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(names)}
                raw, sizes = coder.decode(row).astype("<u4").tobytes(), np.frombuffer(row["lengths"], "<u8").astype(np.int64)
                ends = np.cumsum(sizes)
                texts = [raw[a * 4 : b * 4] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": row["start"] + ends - sizes, "n_tokens": sizes, "ids_crc32": pa.array([zlib.crc32(x) for x in texts], pa.int64())}
                yield common.table(**out, **({"ids": pa.array(texts, pa.binary())} if with_ids else {}))

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; ids (32 bits each) on demand."""
    blocks, freq, bits = read_blocks(spark, path)
    return blocks.mapInArrow(_decode(freq, bits, blocks.columns, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark)
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
