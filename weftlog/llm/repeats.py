"""Suffix-array dedup: later copies of long strings go, the first stays.

A string of `least` bytes that two documents share has the same anchors (16-byte grams of least hash in a run of windows) in
both, so only the surroundings of anchors that several documents have can repeat. Those surroundings meet in buckets by
anchor, equal ones (by hash, then by bytes) of a block joined beforehand; there the suffixes are put in order, and the previous
and next ones of smaller documents in that order give the longest-previous-factor array: how long a string from each place on
an earlier document has. What is removed goes back to the blocks of documents.

An anchor that very many blocks have is no key for one task: its surroundings go to two buckets each, by the anchor with half of
what stands before it and by the anchor with half of what follows. A string over the anchor has the one or the other whole, so
all its places meet in one of the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import again

LEAST, GRAM = 50, 16
#: Bytes of text in a block, and text bytes whose anchors go to one bucket.
BLOCK, BUCKET = 3 << 20, 12 << 20
#: Surroundings in one suffix array, about.
CHUNK = 8_000
#: Blocks that may have an anchor before its surroundings are dealt by halves: cost only.
MANY = 1024
#: Bytes of text whose anchors are found at once.
STRIP = 128 << 10
ONE = np.uint64(1)


def sliding(values: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (a minimum or maximum) over each n consecutive values, by doubling."""
    out, width = values, 1
    while width * 2 <= n:
        out, width = pick(out[:-width], out[width:]), width * 2
    return pick(out[: len(values) - n + 1], out[n - width : n - width + len(values) - n + 1]) if width < n else out


def gram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of grams of 16 bytes, given as two integers."""
    return common.mix(first * common.C1 ^ (second * common.C2 >> np.uint64(7))) & ~ONE


def spread(h: np.ndarray) -> np.ndarray:
    """Anchors have small hashes, by which they were chosen; these are even over the whole range."""
    return common.mix(h ^ common.C3) & ~ONE


def anchors(data: np.ndarray, offs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (even numbers) of the anchors: grams whose hash is the least in some window of one row."""
    span, parts = least - GRAM + 1, []
    cuts = np.unique(np.append(np.searchsorted(offs, np.arange(0, len(data), STRIP)), len(offs) - 1))  # rows by the strip, to stay in the cache
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = int(offs[i]), int(offs[j])
        if b - a < least:
            continue
        view = common.loads(data[a:b])
        n = b - a - GRAM + 1
        h = gram_hash(view[:n], view[8 : n + 8])
        padded = np.zeros(n + span - 1, np.uint64)
        low = padded[span - 1 : n]  # the least hash of the window that starts here, 0 where rows end in it
        low[:] = sliding(h, span, np.minimum)
        for end, begin in zip((offs[i + 1 : j + 1] - a).tolist(), (offs[i:j] - a).tolist(), strict=True):
            low[max(end - least + 1, begin) : end] = 0
        places = np.flatnonzero((sliding(padded, span, np.maximum) == h) & (h > 0))
        parts.append((places + a, spread(h[places])))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; all places at once, by jumping along what is known."""
    out = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        at = out[todo]
        open_ = at >= 0
        todo, at = todo[open_], at[open_]
        higher = values[at] >= values[todo]
        todo, at = todo[higher], at[higher]
        out[todo] = out[at]
    return out


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0, in the shape of keys."""
    flat = keys.ravel()
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    out = np.empty(len(flat), np.int64)
    out[order] = np.cumsum(np.concatenate([np.zeros(1, bool), s[1:] != s[:-1]]))
    return out.reshape(keys.shape)


def previous_factors(texts: np.ndarray, row: np.ndarray, col: np.ndarray, right: np.ndarray, doc: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array of suffixes: those that have a factor of at least `least` bytes, and its length.

    Suffix i is texts[row[i]] from col[i] up to right[i], of document doc[i], with `least` bytes at least; rank orders those
    first bytes. In the order of the whole suffixes the nearest ones of smaller documents, on either side, agree with it the
    furthest; how far is counted in bytes. Suffixes whose first bytes no other has need no order.
    """
    at = np.flatnonzero(np.bincount(rank, minlength=1)[rank] > 1)
    row, col, right, doc, rank = row[at], col[at], right[at], doc[at], rank[at]
    tails, size = [], texts.shape[1]
    flat = texts.ravel()
    for k in range(least, size, 8):
        word = np.zeros(len(row), np.uint64)
        for i in range(8):  # the bytes behind, zeros beyond the suffix's end
            place = col + k + i
            word = (word << np.uint64(8)) | np.where(place < right, flat[np.minimum(row * size + place, len(flat) - 1)], 0).astype(np.uint64)
        if word.any():
            tails.append(word)
    order = np.lexsort((doc, *tails[::-1], rank))
    row, col, right, doc, rank = row[order], col[order], right[order], doc[order], rank[order]
    total = len(doc)
    back, ahead = nearest_smaller(doc), total - 1 - nearest_smaller(doc[::-1])[::-1]
    longest = np.zeros(total, np.int64)
    for other, there in ((back, back >= 0), (ahead, ahead < total)):
        i = np.flatnonzero(there)
        i = i[rank[other[i]] == rank[i]]
        j, length = other[i], np.full(len(i), least, np.int64)
        most = np.minimum(right[i] - col[i], right[j] - col[j])
        live = np.flatnonzero(length < most)
        while len(live):
            k = length[live]
            live = live[texts[row[i[live]], col[i[live]] + k] == texts[row[j[live]], col[j[live]] + k]]
            length[live] += 1
            live = live[length[live] < most[live]]
        longest[i] = np.maximum(longest[i], length)
    found = np.flatnonzero(longest)
    return at[order[found]], longest[found]


def earlier_by_place(texts: np.ndarray, docs: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """As earlier, for very many surroundings of one anchor, in little room: equal strings of one anchor start at one place of their rows."""
    n, width = texts.shape
    low, high = np.full(n, width, np.int64), np.zeros(n, np.int64)
    for start in range(width - least + 1):
        rows = np.flatnonzero((left <= start) & (start + least <= right))
        if len(rows) > 1:
            part = np.ascontiguousarray(texts[rows, start : start + least]).view(f"V{least}").ravel()
            found, length = previous_factors(texts, rows, np.full(len(rows), start), right[rows], docs[rows], np.unique(part, return_inverse=True)[1], least)
            low[rows[found]] = np.minimum(low[rows[found]], start)
            high[rows[found]] = np.maximum(high[rows[found]], start + length)
    return np.minimum(low, high), high


def half_keys(texts: np.ndarray, hashes: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """For each surrounding a hash of the anchor with half of what stands before it, and with half of what follows.

    A string over the anchor has the one or the other whole, so a surrounding that shares neither repeats nothing. 0: the
    document does not reach that far.
    """
    half, size = before // 2, -(-(before // 2) // 8) * 8
    out = []
    for begin, clip in ((before - half, texts[:, -2]), (before + GRAM, texts[:, -1] - np.minimum(texts[:, -1], GRAM))):
        part = np.zeros((len(texts), size), np.uint8)
        part[:, :half] = texts[:, begin : begin + half]
        key = hashes ^ np.uint64(begin)
        for x in part.view(np.uint64).T:
            key = common.mix(key * common.C1 ^ x)
        out.append(np.where(clip >= half, key | ONE, 0))
    return out[0], out[1]


def earlier(texts: np.ndarray, docs: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch (from, to) of each surrounding that strings of smaller documents cover; from = to where there is none.

    texts: a row of bytes for each surrounding, of which those from left to right (exclusive) belong to the document. The
    suffixes of all rows are ranked to a depth of `least` by doubling prefixes of 8 bytes; previous_factors does the rest.
    """
    n, width = texts.shape
    if n > CHUNK:
        return earlier_by_place(texts, docs, left, right, least)
    padded = np.zeros((n, width + 8), np.uint8)
    padded[:, :width] = texts
    view = np.lib.stride_tricks.sliding_window_view(padded, 8, axis=1)[:, :width]
    rank, size = ranks(np.ascontiguousarray(view).view(">u8").reshape(n, width).astype(np.uint64)), 8
    while size < least:
        step = min(size, least - size)
        top = int(rank.max(initial=0)) + 1
        rank = ranks(rank[:, : rank.shape[1] - step] * top + rank[:, step:])
        size += step
    starts = rank.shape[1]
    place = np.arange(starts)
    valid = ((place >= left[:, None]) & (place + least <= right[:, None])).ravel()
    at = np.flatnonzero(valid)
    row, col = np.divmod(at, starts)
    found, length = previous_factors(texts, row, col, right[row], docs[row], rank.ravel()[at], least)
    low, high = np.full(n, width, np.int64), np.zeros(n, np.int64)
    np.minimum.at(low, row[found], col[found])
    np.maximum.at(high, row[found], col[found] + length)
    return np.minimum(low, high), high  # all strings of a surrounding hold its anchor, so they overlap


BLOCKS = "block long, size long, ids array<bigint>, ends binary, data binary"


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink, ids, texts, size, number = zstandard.ZstdCompressor(level=3), [], [], 0, None

        def block() -> pa.RecordBatch:
            return common.table(block=[number], size=[size], ids=pa.array([ids], pa.list_(pa.int64())), ends=pa.array([np.cumsum([len(t) for t in texts], dtype="<i8").tobytes()], pa.binary()), data=pa.array([shrink.compress(b"".join(texts))], pa.binary()))

        for batch in batches:
            data, offs = common.text_bytes(batch.column(2))
            raw, o = data.tobytes(), offs.tolist()
            if number is None:
                number = batch.column(0)[0].as_py() << 32
            for i, doc in enumerate(batch.column(1).to_pylist()):
                if ids and size + o[i + 1] - o[i] > most:
                    yield block()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(doc)
                texts.append(raw[o[i] : o[i + 1]])
                size += len(texts[-1])
        if ids:
            yield block()

    return run


def opened(ids: list, ends: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's bytes, its rows' offsets and ids, and which ids are null."""
    import zstandard

    o = np.concatenate([np.zeros(1, np.int64), np.frombuffer(ends, "<i8")])
    none = np.array([i is None for i in ids], bool)
    return np.frombuffer(zstandard.decompress(data, max_output_size=max(1, int(o[-1]))), np.uint8), o, np.array([i or 0 for i in ids], np.int64), none


def anchored(block: tuple, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and rows of a block's anchors, without those of rows that have no id."""
    data, offs, _, none = block
    places, hashes = anchors(data, offs, least)
    rows = np.searchsorted(offs, places, "right") - 1
    return (places, hashes, rows) if not none.any() else (places[~none[rows]], hashes[~none[rows]], rows[~none[rows]])


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Grows with the hash, so that sorted hashes fall into runs."""
    return (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def hash_bytes(size: int) -> int:
    """Leading bytes of hashes that tell the anchors of a text of so many bytes apart, but for one in some thousands."""
    return min(8, -(-(max(1, size // 16).bit_length() + 14) // 8))


def shortened(h: np.ndarray, width: int) -> np.ndarray:
    """The leading bytes as integers, the lowest bit clear."""
    return (h >> np.uint64(64 - 8 * width)) & ~ONE


def to_bytes(h: np.ndarray, width: int) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_bytes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _announce(least: int, n: int, width: int):
    """Each block's kinds of anchors by bucket; a hash with its lowest bit set has several documents in the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, ends, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                block = opened(ids.as_py(), ends.as_py(), data.as_py())
                _, hashes, rows = anchored(block, least)
                order = np.argsort(hashes, kind="stable")
                h, d = hashes[order], block[2][rows[order]]
                at = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
                if len(at):
                    several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
                    cuts = np.searchsorted(bucket_of(h[at], n), np.arange(n + 1, dtype=np.uint64))
                    h = shortened(h[at], width) | several.astype(np.uint64)
                    full = np.flatnonzero(np.diff(cuts))
                    yield common.table(bucket=pa.array(full, pa.int32()), block=pa.array([number.as_py()] * len(full), pa.int64()), hashes=pa.array([to_bytes(h[cuts[k] : cuts[k + 1]], width) for k in full], pa.binary()))

    return run


def _shared(width: int, many: int):
    """The anchors of a bucket that more than one block has, or more than one document of a block, for each of the blocks.

    The lowest bit of a hash is now set where more than `many` blocks have it.
    """

    def run(told: pa.Table) -> pa.Table:
        lists = [from_bytes(x, width) for x in told["hashes"].to_pylist()]
        s = np.sort(np.concatenate([*lists, np.zeros(0, np.uint64)]))
        kinds, at, blocks = np.unique(s & ~ONE, return_index=True, return_counts=True)
        keep = (blocks > 1) | (s[at + blocks - 1] & ONE == ONE)  # of equal ones those with the bit come last
        several, flagged = kinds[keep], kinds[keep] | (blocks[keep] > many).astype(np.uint64)
        found = []
        for h in lists:
            h = h & ~ONE
            place = np.minimum(np.searchsorted(several, h), max(0, len(several) - 1))
            found.append(to_bytes(flagged[place[several[place] == h]], width) if len(several) else b"")
        return pa.table({"block": told["block"], "hashes": pa.array(found, pa.binary())}).filter(pa.array([bool(f) for f in found], pa.bool_()))

    return run


def packed(**arrays) -> bytes:
    import pickle

    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    import pickle

    import zstandard

    return pickle.loads(zstandard.decompress(raw))


def keys_of(texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the surroundings: of their bytes, and how many of them belong to the document on either side."""
    out = hashes.copy()
    for part in texts.view(np.uint64).T:
        out = common.mix(out * common.C1 ^ part)
    return out


#: Surroundings whose bytes are compared at once.
SOME = 1 << 14


def parted(new: np.ndarray, order: np.ndarray, texts_of) -> np.ndarray:
    """new marks the first of each run of equal hashes in the order; what differs in bytes from the one before begins a run too."""
    same = np.flatnonzero(~new)
    for i in range(0, len(same), SOME):
        part = same[i : i + SOME]
        differ = (texts_of(order[part]) != texts_of(order[part - 1])).any(1)
        new[part[differ]] = True
    return new


def _surround(least: int, n: int, short: int):
    """The distinct surroundings of a block's shared anchors, each with its first document, and where they stand."""
    before = least - GRAM
    width = before + least

    def run(blocks: pa.Table, shared: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "payload": []}
        common.release()
        if blocks.num_rows and shared.num_rows:
            row = blocks.to_pylist()[0]
            data, offs, ids, none = block = opened(row["ids"], row["ends"], row["data"])
            places, hashes, rows = anchored(block, least)
            flagged = np.sort(np.concatenate([from_bytes(x, short) for x in shared["hashes"].to_pylist()]))
            known, brief = flagged & ~ONE, shortened(hashes, short)
            place = np.minimum(np.searchsorted(known, brief), len(known) - 1)
            hit = known[place] == brief
            places, hashes, rows, crowded = places[hit], hashes[hit], rows[hit], (flagged[place[hit]] & ONE).astype(bool)
            left = np.minimum(before, places - offs[rows])
            right = np.minimum(least, offs[rows + 1] - places)
            texts = np.zeros((len(places), -(-(width + 2) // 8) * 8), np.uint8)
            edge = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(least, np.uint8)])
            texts[:, :width] = np.lib.stride_tricks.sliding_window_view(edge, width)[places]
            col = np.arange(width)
            cut = np.flatnonzero((left < before) | (right < least))
            texts[cut, :width] *= (col >= before - left[cut, None]) & (col < before + right[cut, None])
            texts[:, width], texts[:, width + 1] = left, right
            key = keys_of(texts, hashes)
            order = np.lexsort((key, hashes))
            h, k = hashes[order], key[order]
            new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
            new = parted(new, order, lambda rows: texts[rows])
            at = np.flatnonzero(new)
            first = np.minimum.reduceat(ids[rows[order]], at)
            one = order[at]
            rare, often = np.flatnonzero(~crowded[one]), np.flatnonzero(crowded[one])
            ends = np.append(at, len(h))
            deals = [(0, rare, h[at[rare]])]
            for kind, half in enumerate(half_keys(texts[one[often], : width + 2], h[at[often]], before), 1):
                deals.append((kind, often[half > 0], half[half > 0]))
            for kind, some, by in deals:
                bucket = bucket_of(by, n)
                if kind:
                    turn = np.argsort(bucket, kind="stable")
                    some, bucket = some[turn], bucket[turn]
                count = ends[some + 1] - ends[some]
                edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
                spots = places[order[np.arange(edges[-1]) + np.repeat(ends[some] - edges[:-1], count)]].astype(np.uint32 if len(data) < 1 << 32 else np.int64)
                group = np.repeat(np.arange(len(some)), count)
                cuts = np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    i, j = cuts[b], cuts[b + 1]
                    x, y = edges[i], edges[j]
                    out["bucket"].append(b)
                    out["block"].append(row["block"])
                    out["payload"].append(packed(kind=kind, first=first[some[i:j]], texts=texts[one[some[i:j]], : width + 2], places=spots[x:y], group=(group[x:y] - i).astype(np.uint32)))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int64(), pa.binary()), strict=True)})

    return run


def _compare(least: int):
    """What earlier documents cover of each surrounding's first document, for all surroundings of a bucket."""
    before = least - GRAM
    width = before + least

    def run(told: pa.Table) -> pa.Table:
        common.release()
        parts = [unpacked(x) for x in told["payload"].to_pylist()]
        first, h, k, halves = np.concatenate([p["first"] for p in parts]), [], [], []
        for p in parts:
            texts = np.zeros((len(p["texts"]), -(-(width + 2) // 8) * 8), np.uint8)
            texts[:, : width + 2] = p["texts"]
            anchor = spread(gram_hash(*(np.ascontiguousarray(texts[:, i : i + 8]).view(np.uint64).ravel() for i in (before, before + 8))))
            halves.append(half_keys(p["texts"], anchor, before))
            h.append((anchor, *halves[-1])[p["kind"]])  # what the rows were dealt by
            k.append(keys_of(texts, h[-1]))
        h, k, halves = np.concatenate(h), np.concatenate(k), [np.concatenate(x) for x in zip(*halves, strict=True)]
        order = np.lexsort((first, k, h))
        new = np.concatenate([np.ones(1, bool), (h[order][1:] != h[order][:-1]) | (k[order][1:] != k[order][:-1])])
        at = np.cumsum([0, *(len(p["first"]) for p in parts)])

        def texts_of(rows: np.ndarray) -> np.ndarray:
            part, out = np.searchsorted(at, rows, "right") - 1, np.empty((len(rows), width + 2), np.uint8)
            by = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[by], np.arange(len(parts) + 1))
            for p in np.flatnonzero(np.diff(ends)).tolist():
                mine = by[ends[p] : ends[p + 1]]
                out[mine] = parts[p]["texts"][rows[mine] - at[p]]
            return out

        new = parted(new, order, texts_of)
        one = order[new]  # the first document of each surrounding, all blocks together
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        low, high = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        anchor = h[one]
        todo = np.flatnonzero(reduce(np.logical_or, (again(x[one]) & (x[one] > 0) for x in halves)))
        i = 0
        while i < len(todo):
            j = min(len(todo), i + CHUNK)
            while j < len(todo) and anchor[todo[j]] == anchor[todo[j - 1]]:
                j = min(len(todo), int(np.searchsorted(anchor[todo], anchor[todo[j - 1]], "right")))
            rows = one[todo[i:j]]
            texts = texts_of(rows)
            left, right = texts[:, width].astype(np.int64), texts[:, width + 1].astype(np.int64)
            low[todo[i:j]], high[todo[i:j]] = earlier(texts[:, :width], first[rows], before - left, before + right, least)
            i = j
        firsts, out = first[one], []
        for p, a, b in zip(parts, at[:-1].tolist(), at[1:].tolist(), strict=True):
            g = group[a:b]
            out.append(packed(first=firsts[g], low=low[g].astype(np.uint8), high=high[g].astype(np.uint8), clips=p["texts"][:, width:], places=p["places"], group=p["group"]))
        return pa.table({"block": told["block"], "payload": pa.array(out, pa.binary())})

    return run


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(least: int, with_kept: bool):
    before = least - GRAM

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        common.release()
        for row in blocks.to_pylist():
            data, offs, ids, none = opened(row["ids"], row["ends"], row["data"])
            starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in map(unpacked, found["payload"].to_pylist()):
                g, places = x["group"], x["places"].astype(np.int64)
                doc, first, clips = ids[np.searchsorted(offs, places, "right") - 1], x["first"][g], x["clips"][g].astype(np.int64)
                later = doc > first
                a = np.where(later, places - clips[:, 0], places - before + x["low"][g])
                b = np.where(later, places + clips[:, 1], places - before + x["high"][g])
                some = later | (x["high"][g] > x["low"][g])
                starts.append(a[some])
                ends.append(b[some])
            a, b = np.concatenate(starts), np.concatenate(ends)
            line = np.searchsorted(offs, a, "right") - 1
            order = np.argsort(a, kind="stable")
            a, b, line = a[order] + line[order], b[order] + line[order], line[order]  # a gap between rows
            reach = np.maximum.accumulate(b) if len(b) else b
            new = np.concatenate([np.ones(min(1, len(a)), bool), a[1:] > reach[:-1]])
            s = np.flatnonzero(new)
            line, a, b = line[s], a[s] - line[s], (reach[np.append(s[1:], len(a)) - 1] - line[s]) if len(s) else b
            firsts = np.searchsorted(line, np.arange(len(ids) + 1))
            raw, o, a, b, firsts = memoryview(data), offs.tolist(), a.tolist(), b.tolist(), firsts.tolist()
            for i in range(len(ids)):
                at, digest, gone, kept = o[i], hashlib.sha256(), 0, []
                for x, y in zip(a[firsts[i] : firsts[i + 1]], b[firsts[i] : firsts[i + 1]], strict=True):
                    kept.append(raw[at:x])
                    gone, at = gone + y - x, y
                kept.append(raw[at : o[i + 1]])
                for part in kept:
                    digest.update(part)
                values = (None if none[i] else int(ids[i]), o[i + 1] - o[i], gone, firsts[i + 1] - firsts[i], digest.hexdigest(), b"".join(kept) if with_kept else None)
                for column, v in zip(out.values(), values, strict=True):
                    column.append(v)
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True) if k != "kept" or with_kept})

    return run


def remove_repeats(docs: DataFrame, least: int = LEAST, with_kept: bool = False, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, many: int = MANY) -> DataFrame:
    """A row for each row of docs: its bytes, how many of them go, in how many spans, the digest of the rest (and the rest).

    A byte goes if a string of `least` bytes (24 to 120) over it also starts in a document of a smaller id; matches never cross
    documents. Null text is empty. A row without an id removes nothing and loses nothing. Rows that share an id leave each
    other alone. An empty table gives no rows; other columns play no part.
    """
    if not 24 <= least <= 120:
        raise ValueError("least must lie between 24 and 120")
    spark = docs.sparkSession
    common.tune(spark)
    rows = common.two(docs, id_col, text_col).select(F.spark_partition_id().alias("task"), "id", "text")
    blocks = common.save(rows.mapInArrow(_blocks(block), BLOCKS), codec="none")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    n, width = common.parts(spark, total, BUCKET), hash_bytes(total)
    told = blocks.select("block", "ids", "ends", "data").mapInArrow(_announce(least, n, width), "bucket int, block long, hashes binary")
    shared = told.groupBy("bucket").applyInArrow(_shared(width, many), "block long, hashes binary")
    around = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_surround(least, n, width), "bucket int, block long, payload binary")
    found = around.groupBy("bucket").applyInArrow(_compare(least), "block long, payload binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(least, with_kept), CUT + ", kept binary" * with_kept)


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
