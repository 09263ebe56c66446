"""Benchmark decontamination by suffix arrays over the training text.

Each shard (a batch of documents) becomes one string of word numbers, of which only stretches of benchmark words matter: a
word that no benchmark item has cannot be part of a match. Its suffix array is built by prefix doubling, every suffix of every
benchmark item is looked up by binary search, and the ranges found give all verbatim matches and their places. Equal windows are looked
up once, whatever number of items has them; a place has one window of each length at most, so nothing is paired with all else.
How far a match goes on is read off the two neighbours that a place has among the sorted suffixes of the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Bytes that part words, after A-Z is lower-cased: 00-2F, 3A-60 and 7B-7F.
WORD = ~common.byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WORD[65:91] = True  # upper case, before it is lowered
WINDOW = 10
#: Characters of benchmark text that go to the tasks at once; a larger benchmark is searched block after block.
BLOCK_CHARS = 8 << 20
#: Bytes of documents in one suffix array.
SHARD_BYTES = 6 << 20


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words and the index of each row's first."""
    data, offs = common.text_bytes(column)
    starts, ends, first = common.runs(WORD[data], offs)
    return common.hash_words(common.LOWER[data], starts, ends), first


class Suites:
    """A block of benchmark items, ready for the search: their vocabulary, every suffix that starts a window, and the distinct windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        hashes, first = word_hashes(pa.array([t for _, t in items], pa.string()))
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.window, self.names, sizes = window, [i for i, _ in items], np.diff(first)
        span = np.minimum(window, sizes)
        # the items' words, each with a 0 behind it
        item_of = np.repeat(np.arange(len(items)), sizes)
        self.text = np.zeros(len(ids) + len(items) + 1, np.int64)
        self.text[np.arange(len(ids)) + item_of] = ids + 1
        counts = np.where(sizes > 0, sizes - span + 1, 0)
        item = np.repeat(np.arange(len(items)), counts)
        start = np.repeat(first[:-1] + np.arange(len(items)) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        need, rest = span[item], (first[1:] + np.arange(len(items)))[item] - start
        self.shortest = int(need.min()) if len(need) else 0
        self.longest = int(rest.max()) if len(rest) else 0
        self.table = np.zeros(1 << 20, bool)
        self.table[self.vocabulary & np.uint64((1 << 20) - 1)] = True
        # the suffixes in order; those of one window are neighbours, the shorter windows apart by their length
        place = np.empty(len(self.text), np.int64)
        place[suffix_array(self.text, max(self.longest, 1))] = np.arange(len(self.text))
        order = np.argsort(place[start], kind="stable")
        self.sorted, self.rest = start[order], rest[order]
        words = self.text[np.minimum(start[:, None] + np.arange(window), len(self.text) - 1)] * (np.arange(window) < need[:, None])
        order = np.lexsort(tuple(words.T[::-1])) if len(words) else np.zeros(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (words[order][1:] != words[order][:-1]).any(1)
        one = order[np.flatnonzero(new)]
        self.start, self.need = start[one], need[one]
        # the items of each window, each once
        which = np.cumsum(new) - 1
        has = np.unique(np.stack([which, item[order]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
        self.items, self.item_at = has[1], np.searchsorted(has[0], np.arange(len(one) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.table[hashes & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[place] == hashes[maybe] if len(maybe) else np.zeros(0, bool)
        out[maybe[hit]] = place[hit] + 1
        return out

    def names_of(self, windows: np.ndarray) -> list[str]:
        """The items that have one of the windows, each once, without those that have no id."""
        found = np.unique(np.concatenate([self.items[self.item_at[w] : self.item_at[w + 1]] for w in windows.tolist()]))
        return sorted({n for i in found.tolist() if (n := self.names[i]) is not None})


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first depth numbers, at least (prefix doubling; 0 is below all)."""
    rank, width = text.copy(), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-width] = rank[width:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank[order] = np.cumsum(np.concatenate([np.zeros(min(1, len(s)), bool), s[1:] != s[:-1]])) + 1
        width *= 2
        if len(rank) and int(rank.max()) == len(rank):
            break
    return order


def common_prefix(text: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal numbers, at most most[i], of text from at[i] and query from start[i] on. Each text ends in 0, and a 0 equals nothing."""
    out, live = np.zeros(len(at), np.int64), np.flatnonzero(most > 0)
    while len(live):
        k = out[live]
        x = text[np.minimum(at[live] + k, len(text) - 1)]
        live = live[(x == query[np.minimum(start[live] + k, len(query) - 1)]) & (x > 0)]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def bound(text: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """For each stretch of query (from start on, most long) the first place in the order of suffixes that is not below it (after: above it)."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        k = common_prefix(text, order[mid], query, start[live], most[live])
        full = k == most[live]
        below = ~full & (text[np.minimum(order[mid] + k, len(text) - 1)] < query[np.minimum(start[live] + k, len(query) - 1)])
        right = below | full if after else below
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
    return low


def matches(hashes: np.ndarray, first: np.ndarray, s: Suites) -> tuple[np.ndarray, ...]:
    """Where distinct windows stand: document word and window; and of each such word, once, how many words agree from there on."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(s.start) or not len(hashes):
        return none
    numbers = s.numbers(hashes)
    a, b, _ = common.runs(numbers > 0, first)
    live = b - a >= s.shortest
    a, b = a[live], b[live]
    if not len(a):
        return none
    # the stretches, each with a 0 behind it
    size = b - a + 1
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) + np.repeat(a - (ends - size), size)
    text = np.where(np.arange(ends[-1]) == np.repeat(ends - 1, size), 0, numbers[np.minimum(place, len(numbers) - 1)])
    order = suffix_array(text, int(s.need.max()))
    low, high = (bound(text, order, s.text, s.start, s.need, x) for x in (False, True))
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    places, whole = np.unique(at, return_inverse=True)
    # from a whole window on, a place's neighbours among the sorted suffixes agree with it the furthest; shorter windows are whole items
    above = bound(s.text, s.sorted, text, places, np.full(len(places), s.longest + 1), False)
    near = [np.clip(above - k, 0, len(s.sorted) - 1) for k in (0, 1)]
    size = np.maximum(*(common_prefix(text, places, s.text, s.sorted[k], s.rest[k]) for k in near)) if len(places) else places
    short = np.zeros(len(places), np.int64)
    np.maximum.at(short, whole, s.need[which])
    return place[at], which, place[places], np.where(size >= s.window, size, short)


def search(column: pa.Array, s: Suites) -> dict[str, np.ndarray]:
    """Of each row: n_words and longest; hit (by word); row and window of each pair that matches, in order."""
    hashes, first = word_hashes(column)
    at, which, places, size = matches(hashes, first, s)
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + s.need[which] if len(at) else at, -1)
    longest = np.zeros(len(first) - 1, np.int64)
    np.maximum.at(longest, np.searchsorted(first, places, "right") - 1, size)
    row = np.searchsorted(first, at, "right") - 1
    pairs = np.unique(np.stack([row, which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    return {"n_words": np.diff(first), "first": first, "hit": np.cumsum(change[:-1]) > 0, "longest": longest, "row": pairs[0], "window": pairs[1]}


def listed(f: dict[str, np.ndarray], rows: int, s: Suites) -> Iterator[list[str]]:
    """The items of each row; rows with the same windows share one list."""
    cuts, made = np.searchsorted(f["row"], np.arange(rows + 1)).tolist(), {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        windows = f["window"][a:b]
        if b > a and windows.tobytes() not in made:
            made[windows.tobytes()] = s.names_of(windows)
        yield made[windows.tobytes()] if b > a else []


STATE = "doc_id long, text string, n_words long, hits binary, items array<string>, longest long"
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


def _search(block, window: int, has_state: bool):
    """Adds what one block of items finds to each row's state: a bit for each word that is hit, the items, the longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        suites = Suites(block.value, window)
        for batch in common.rebatch(batches, SHARD_BYTES):
            f = search(batch.column(1), suites)
            bits = [np.packbits(f["hit"][a:b]).tobytes() if f["longest"][i] else b"" for i, (a, b) in enumerate(zip(f["first"][:-1].tolist(), f["first"][1:].tolist(), strict=True))]
            items = list(listed(f, len(bits), suites))
            if has_state:
                for i, (old, names, longest) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)):
                    if old:
                        bits[i] = np.bitwise_or(np.frombuffer(old, np.uint8), np.frombuffer(bits[i], np.uint8)).tobytes() if bits[i] else old
                    if names:
                        items[i] = [*items[i], *names]
                    f["longest"][i] = max(f["longest"][i], longest)
            whole = {"doc_id": batch.column(0), "text": batch.column(1), "n_words": pa.array(f["n_words"], pa.int64()), "hits": pa.array(bits, pa.binary()), "longest": pa.array(f["longest"], pa.int64())}
            for a, b in parts_of(items):
                yield common.table(**{k: v.slice(a, b - a) for k, v in whole.items() if k != "longest"}, items=pa.array(items[a:b], pa.list_(pa.string())), longest=whole["longest"].slice(a, b - a))

    return run


#: Items that one batch lists, about.
LISTED = 200_000


def parts_of(items: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Runs of rows that list about so many items together."""
    begin, size = 0, 0
    for i, x in enumerate(items):
        size += len(x)
        if size >= LISTED:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(items):
        yield begin, len(items)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: dict[tuple, tuple[int, str]] = {}  # many rows list the same items

        def told(x: list[str]) -> tuple[int, str]:
            if (k := tuple(x)) not in made:
                names = sorted(set(k))
                made[k] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
            return made[k]

        hit = np.array([int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in batch.column(2).to_pylist()], np.int64)
        names = [told(x) for x in batch.column(3).to_pylist()]
        yield common.table(doc_id=batch.column(0), n_words=batch.column(1), n_hit=hit, n_items=pa.array([k for k, _ in names], pa.int64()), items_sha256=pa.array([x for _, x in names], pa.string()), contaminated=hit > 0, longest_match=batch.column(4))


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size, one block at a time on the driver. An empty benchmark gives one empty block."""
    held, size, any_block = [], 0, False
    for r in benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t or "") + 16
        if size >= most:
            yield held
            held, size, any_block = [], 0, True
    if held or not any_block:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each row of docs: its words, those inside benchmark windows, the items found, and the longest match in words.

    Null or empty texts have no words, on either side. A null item id marks words but is not listed; rows that share an item id
    are one item. Null document ids and repeated rows stay; an empty table or benchmark finds nothing; other columns play no part.
    """
    common.tune(docs.sparkSession)
    state = common.two(docs, id_col, text_col)
    for k, block in enumerate(blocks_of(benchmark, item_col, item_text_col, block_chars)):
        state = state.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(block), window, k > 0), STATE)
    return state.select("doc_id", "n_words", "hits", "items", "longest").mapInArrow(_sum_up, FOUND)


def _clean(block, window: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        suites = Suites(block.value, window)
        for batch in common.rebatch(batches, SHARD_BYTES):
            yield batch.filter(pa.array(search(batch.column(at), suites)["longest"] == 0))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, in which no benchmark window stands."""
    common.tune(docs.sparkSession)
    for block in blocks_of(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), window, docs.columns.index(text_col)), docs.schema)
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("longest_match")
