"""N-gram Jaccard join: a size-aware heavy-light join, then components.

Sets below a boundary are light: they list all their subsets of the sizes that a partner may share, so that two light sets link
if and only if they meet in a subset that is large enough for both. Heavy sets, and light ones near the boundary, enter
inverted lists with the first elements of a common order (frequent ones last) that any partner must share; the lists are
scanned for pairs, which are verified on whole texts. The boundary is where the two ways cost the same over all sizes.

No list is turned into all its pairs. A long list first links its members to a pivot of like size; only members that the
verified links leave in different components are compared with each other, and then all of them are. Lists that are long
in one batch already are reduced to their pivots there, so that no list, however many sets it has, comes to one task whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import again
from .repeats import bucket_of, packed, unpacked

#: How many elements are known to be frequent and come last in the order: a hint, which changes no result.
FREQUENT = 1 << 19
#: An element counts as frequent in a batch from so many sets on, and over all from so many.
OFTEN, OFTEN_IN_ALL = 3, 12
#: Lists of so many members are paired at once; longer ones start with pivots.
SHORT = 4
#: Cost of verifying, in list entries for each element of a set; and sizes beyond which sets are never light.
VERIFY, MOST_LIGHT = 1.0, 40
#: Postings that go to one bucket, about; pivots of more partners than this are dealt to several tasks.
BUCKET, SPOKES = 500_000, 2_000
#: Texts that come to one task to be compared, about.
TEXTS = 50_000
#: Members of one list in one batch from which on only their pivots go to the list's bucket; and the bit of n that marks those.
COMBINE, STANDS = 64, np.uint32(1 << 31)
#: Bytes of text that are hashed at once, of a batch whose elements are counted, and of sets whose entries are dealt out at once.
AT_ONCE, COUNT_BYTES, POST_BYTES = 1 << 20, 8 << 20, 4 << 20
#: The logarithm of the most bits of a filter of ids: 32 MB.
BLOOM = 28


class Rule:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def holds(self, both, a, b):
        return self.den * both >= self.num * (a + b - both)

    def least(self, n: int) -> int:
        """Elements that a set of n shares with any partner."""
        return -(-self.num * n // self.den)

    def missing(self, n: int) -> int:
        return n - self.least(n)

    def both(self, a, b):
        """Elements that sets of a and b share at least if they link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def alike(self, a, b):
        """Whether sizes allow a link."""
        return (self.num * a <= self.den * b) & (self.num * b <= self.den * a)


def _tie(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; fewer words: of the whole sequence; none: empty."""
    return [s for part in common.slices(column, AT_ONCE) for s in _shingle_sets(part, n)]


def _shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    data, offs = common.text_bytes(column)
    starts, ends, first = common.runs(common.WORD[data], offs)
    words = common.hash_words(common.LOWER[data], starts, ends)
    grams, first = common.gram_hashes(words, n), first.tolist()
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([np.ones(1, bool), s[1:] != s[:-1]])])
        else:
            out.append(common.gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _frequent(n: int):
    """Of each batch: the elements that many of its sets have, and how many sets of each small size there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.rebatch(batches, COUNT_BYTES):
            sets = shingle_sets(batch.column(1), n)
            s = np.sort(np.concatenate([*sets, np.zeros(0, np.uint64)]))
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
            count = np.diff(np.append(at, len(s)))
            at, count = at[count >= OFTEN], count[count >= OFTEN]
            kinds = np.bincount([len(x) for x in sets])[: 2 * MOST_LIGHT]
            none = [None] * len(at), [None] * len(kinds)
            yield common.table(element=pa.array([*s[at].view(np.int64).tolist(), *none[1]], pa.int64()), size=pa.array([*none[0], *range(len(kinds))], pa.int64()), n=np.concatenate([count, kinds]).astype(np.int64))

    return run


@cache
def choices(n: int, k: int) -> np.ndarray:
    """All ways to leave k of n elements out, one a row; n is at most MOST_LIGHT."""
    return np.array(list(combinations(range(n), k)), np.int64).reshape(math.comb(n, k), k)


def subset_keys(s: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and sizes of the subsets of s that lack as many elements as a partner may lack, or fewer; and 32 further bits of hash."""
    each, other = common.mix(s + common.C2), common.mix(s ^ common.C1)
    total, rest, keys, sizes, checks = each.sum(dtype=np.uint64), other.sum(dtype=np.uint64), [], [], []
    for k in range(rule.missing(len(s)) + 1):
        chosen = choices(len(s), k)
        gone = each[chosen].sum(1, dtype=np.uint64)
        keys.append(common.mix((total - gone) ^ np.uint64((len(s) - k) * int(common.C3) & (1 << 64) - 1)))
        sizes.append(np.full(len(gone), len(s) - k, np.uint32))
        checks.append((common.mix(rest - other[chosen].sum(1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(keys), np.concatenate(sizes), np.concatenate(checks)


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of at least len(s) places (a power of 2): whether an odd number of elements fall there.

    Each element that two sets do not share changes one bit at most, so the bits that differ bound those elements from below.
    """
    places = 64
    while places < len(s):
        places *= 2
    return np.packbits(np.bincount((common.mix(s) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


#: Words of 64 bits in the sketch that all sets have in the same length.
BRIEF = 8


def brief(s: np.ndarray) -> list[int]:
    """A sketch of BRIEF words, whatever the size of the set."""
    return np.packbits(np.bincount((common.mix(s ^ common.C3) & np.uint64(64 * BRIEF - 1)).astype(np.int64), minlength=64 * BRIEF) & 1, bitorder="little").view(np.int64).tolist()


def differing(a: bytes, b: bytes) -> int:
    """Places where two sketches differ, the longer one folded to the shorter one's length."""
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a)
    if len(a) < len(b):
        x, y, a, b = y, x, b, a
        size = len(a)
    while size > len(b):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ y).bit_count()


SETS = "id long, n long, key binary, tie long, entries binary, sizes binary, checks binary, sketch binary, brief array<bigint>"


def _sets(n: int, rule: Rule, boundary: int, frequent):
    """Each row's set: its size and digest, and its entries (size 0: an element of the inverted lists; else a subset's size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        known, rank = frequent.value
        near = rule.least(boundary)
        for batch in batches:
            sets, keys, entries, sizes, checks = shingle_sets(batch.column(1), n), [], [], [], []
            for s in sets:
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                e, c, check = [], [], b""
                if 0 < len(s) < boundary:
                    k, size, more = subset_keys(s, rule)
                    e.append(k)
                    c.append(size)
                    check = more.tobytes()
                if len(s) >= max(1, near):
                    take, head = rule.missing(len(s)) + 1, s
                    if len(known):
                        place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[place] == s
                        if often.any():
                            last = s[often][np.argsort(rank[place[often]], kind="stable")]
                            head = np.concatenate([s[~often], last])
                    e.append(head[:take])
                    c.append(np.zeros(min(take, len(head)), np.uint32))
                entries.append(np.concatenate([*e, np.zeros(0, np.uint64)]).tobytes())
                sizes.append(np.concatenate([*c, np.zeros(0, np.uint32)]).tobytes())
                checks.append(check)
            yield common.table(id=batch.column(0), n=np.array([len(s) for s in sets], np.int64), key=pa.array(keys, pa.binary()), tie=np.array([_tie(k) for k in keys], np.int64), entries=pa.array(entries, pa.binary()), sizes=pa.array(sizes, pa.binary()), checks=pa.array(checks, pa.binary()), sketch=pa.array([sketch(s) for s in sets], pa.binary()), brief=pa.array([brief(s) for s in sets], pa.list_(pa.int64())))

    return run


def boundary_of(sizes: list[tuple[int, int]], rule: Rule) -> int:
    """The size below which sets are light, by the sum of both ways' costs. sizes: (size, number of sets)."""

    def light(n: int) -> float:
        return sum(math.comb(n, k) for k in range(rule.missing(n) + 1))

    def heavy(n: int) -> float:
        return rule.missing(n) + 1 + VERIFY * n

    def cost(b: int) -> float:
        return sum(c * ((light(n) if n < b else 0) + (heavy(n) if n >= rule.least(b) else 0)) for n, c in sizes if n)

    return min(range(1, MOST_LIGHT + 1), key=lambda b: (cost(b), b))


POSTED = "bucket int, kind int, payload binary"
#: Kinds of rows: postings, pairs to verify (of light sets too), members of long lists.
POST, PAIRS, MEMBERS = 0, 1, 2
FIELDS = ("element", "id", "tie", "n", "size", "pos")
MEMBER = ("element", "id", "tie", "n", "pos")


class Lists:
    """Postings in order of their lists (by element; for subsets also by size and by a second hash, their `pos`), then by size of set."""

    def __init__(self, x: dict[str, np.ndarray]):
        check = np.where(x["size"] > 0, x["pos"], 0)
        n = x["n"] & ~STANDS
        order = np.lexsort((x["tie"], x["id"], n, check, x["size"], x["element"]))
        self.x = x = {k: v[order] for k, v in x.items()}
        self.stands, self.n = x["n"] & STANDS > 0, n[order].astype(np.int64)
        check, total = check[order], len(order)
        new = np.ones(total, bool)
        new[1:] = (x["element"][1:] != x["element"][:-1]) | (x["size"][1:] != x["size"][:-1]) | (check[1:] != check[:-1])
        self.begins = np.append(np.flatnonzero(new), total)
        self.count = np.diff(self.begins)
        self.at, self.head, self.length = np.arange(total), np.repeat(self.begins[:-1], self.count), np.repeat(self.count, self.count)
        self.subset, self.size, self.pos = x["size"] > 0, x["size"].astype(np.int64), x["pos"].astype(np.int64)

    def stars(self, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Light: the smallest member with all that the subset is large enough for; if two others link there, both link with it."""
        to = np.flatnonzero(self.subset & rule.holds(self.size, self.n[self.head], self.n))
        return self.head[to], to

    def bands(self, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Of each place the pivot of its band of like sizes in its list; and which places begin a band.

        The pivot is the band's member of the smallest id, so that most lists of a group of copies choose the same.
        """
        band = band_of(self.n, rule)
        new = np.ones(len(band), bool)
        new[1:] = (self.head[1:] != self.head[:-1]) | (band[1:] != band[:-1])
        first = np.maximum.accumulate(np.where(new, self.at, 0)) if len(new) else self.at
        by_id = np.lexsort((self.x["tie"], self.x["id"], first))
        return by_id[np.searchsorted(first[by_id], first)] if len(new) else self.at, new

    def spokes(self, rule: Rule, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Heavy: of the long lists each member with its band's pivot, and each pivot with the next band's; and the pivots."""
        pivot, new = self.bands(rule)
        i, start = np.flatnonzero(long), np.flatnonzero(new)
        s = start[1:][long[start[1:]] & (self.head[start[1:]] == self.head[start[:-1]])] if len(start) > 1 else start[:0]
        return np.concatenate([pivot[i], pivot[s - 1]]), np.concatenate([i, pivot[s]]), np.unique(pivot[i])

    def pairs(self, a: np.ndarray, b: np.ndarray, ok: np.ndarray | None = None) -> np.ndarray:
        return pairs_of(self.x, a if ok is None else a[ok], b if ok is None else b[ok])

    def members(self, which: np.ndarray) -> dict[str, np.ndarray]:
        return {k: self.n[which].astype(np.uint32) if k == "n" else self.x[k][which] for k in MEMBER}


def band_of(n: np.ndarray, rule: Rule) -> np.ndarray:
    """Sets that link are in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(rule.num / rule.den)).astype(np.int64) if rule.num < rule.den else n


def combined(x: dict[str, np.ndarray], rule: Rule, boundary: int) -> tuple[dict[str, np.ndarray], list[tuple[int, dict[str, np.ndarray]]]]:
    """The postings that go on to the buckets, and what the lists that are long in this batch give here already."""
    kinds = np.unique(x["element"], return_inverse=True)[1]
    often = np.bincount(kinds, minlength=1)[kinds] >= COMBINE
    if not often.any():
        return x, []
    lists = Lists({k: v[often] for k, v in x.items()})
    long = lists.length >= COMBINE
    heavy = long & ~lists.subset
    a, b = lists.stars(rule)
    of_long = long[b]
    c, d, pivots = lists.spokes(rule, heavy)
    ok = rule.alike(lists.n[c], lists.n[d]) & (np.maximum(lists.n[c], lists.n[d]) >= boundary)
    rest, stand = {k: v[~long] for k, v in lists.x.items()}, {k: v[pivots] for k, v in lists.x.items()}
    stand["n"] = stand["n"] | STANDS
    heads = np.unique(lists.head[long & lists.subset])
    go = {k: np.concatenate([x[k][~often], rest[k], stand[k], lists.x[k][heads]]) for k in FIELDS}
    return go, [(PAIRS, lists.pairs(np.concatenate([a[of_long], c[ok]]), np.concatenate([b[of_long], d[ok]]))), (MEMBERS, lists.members(heavy))]


def _posts(n_buckets: int, rule: Rule, boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.rebatch(batches, POST_BYTES):
            ids, ties, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            entries, sizes = (batch.column(k).to_pylist() for k in (3, 4))
            row = np.repeat(np.arange(len(ids)), [len(e) // 8 for e in entries])
            size, element = np.frombuffer(b"".join(sizes), np.uint32), np.frombuffer(b"".join(entries), np.uint64)
            heads = np.concatenate([np.zeros(1, np.int64), np.cumsum(size == 0)])  # of inverted lists so far
            begin = np.cumsum([0, *(len(e) // 8 for e in entries)])[:-1]
            pos = np.where(size == 0, heads[:-1] - heads[begin[row]], 0).astype(np.uint32)
            checks = batch.column(5).to_pylist()
            pos[size > 0] = np.frombuffer(b"".join(checks), np.uint32)
            x, made = combined({"element": element, "id": ids[row], "tie": ties[row], "n": n[row].astype(np.uint32), "size": size, "pos": pos}, rule, boundary)
            even = common.mix(x["element"] ^ common.C3)  # the first elements of sets have small hashes
            order = np.argsort(even, kind="stable")
            x = {k: v[order] for k, v in x.items()}
            cuts = np.searchsorted(bucket_of(even[order], n_buckets), np.arange(n_buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            rows = [(b, POST, packed(**{k: v[cuts[b] : cuts[b + 1]] for k, v in x.items()})) for b in full]
            rows += [(int(k.sum() % n_buckets), kind, packed(**v)) for kind, v in made if len(k := next(iter(v.values())))]
            yield common.table(bucket=pa.array([r[0] for r in rows], pa.int32()), kind=pa.array([r[1] for r in rows], pa.int32()), payload=pa.array([r[2] for r in rows], pa.binary()))

    return run


def pairs_of(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Members a and b of lists as pairs, the smaller one first, each pair once."""
    ids, ties = x["id"], x["tie"]
    turn = (ids[a] > ids[b]) | ((ids[a] == ids[b]) & (ties[a] > ties[b]))
    a, b = np.where(turn, b, a), np.where(turn, a, b)
    out = np.stack([ids[a], ties[a], ids[b], ties[b]], 1)
    out = out[(out[:, 0] != out[:, 2]) | (out[:, 1] != out[:, 3])]
    out = np.unique(out, axis=0) if len(out) else out
    return dict(zip(("a_id", "a_tie", "b_id", "b_tie"), out.T, strict=True))


def _lists(rule: Rule, boundary: int):
    """What the lists of a bucket give: pairs to verify, and the members of lists that stay open; those of batches pass through."""

    def run(told: pa.Table) -> pa.Table:
        common.release()
        kinds, payloads = told["kind"].to_pylist(), told["payload"].to_pylist()
        passed = [(k, p) for k, p in zip(kinds, payloads, strict=True) if k != POST]
        parts = [unpacked(p) for k, p in zip(kinds, payloads, strict=True) if k == POST]
        del payloads
        if not parts:
            parts = [{k: np.zeros(0, t) for k, t in zip(FIELDS, (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint32), strict=True)}]
        # one that is alone in its list finds nothing
        keep = again(np.concatenate([p["element"] for p in parts]))
        lists = Lists({k: np.concatenate([p[k] for p in parts])[keep] for k in FIELDS})
        del parts
        # a list of which some members were left in their batches is long, whatever has come
        open_ = np.repeat(np.logical_or.reduceat(lists.stands, lists.begins[:-1]), lists.count) if len(lists.at) else lists.stands
        long = ~lists.subset & ((lists.length > SHORT) | open_)
        light, (a, b, _) = lists.stars(rule), lists.spokes(rule, long)
        a, b, n, pos, at = [a], [b], lists.n, lists.pos, lists.at
        for k in range(1, SHORT):
            i = np.flatnonzero(~lists.subset & ~long & (at - lists.head >= k))
            # a pair is found in the list of its first common element, behind which enough must be left
            i = i[np.minimum(n[i] - pos[i], n[i - k] - pos[i - k]) >= rule.both(n[i], n[i - k])]
            a.append(i - k)
            b.append(i)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = rule.alike(n[a], n[b]) & (np.maximum(n[a], n[b]) >= boundary)
        pairs = lists.pairs(np.concatenate([light[0], a[ok]]), np.concatenate([light[1], b[ok]]))
        rows = [(PAIRS, pairs, "a_id"), (MEMBERS, lists.members(long & ~lists.stands), "id")]
        rows = [(kind, packed(**v)) for kind, v, k in rows if len(v[k])] + passed
        return pa.table({"bucket": pa.array([0] * len(rows), pa.int32()), "kind": pa.array([k for k, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})

    return run


def _unpack(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                x = unpacked(p)
                yield common.table(**{k: x[k].astype(np.uint64).view(np.int64) if k == "element" else x[k].astype(np.int64) for k in names})

    return run


PAIR = "a_id long, a_tie long, b_id long, b_tie long"
NODE = ("id", "tie")


def _verify(n: int, rule: Rule):
    """Rows come by group (a pivot's, or a part of its partners), the pivot first; gives the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        group = pivot = None
        for batch in batches:
            sets = shingle_sets(batch.column(5), n)
            out = []
            for s, a_id, a_tie, salt, b_id, b_tie in zip(sets, *(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4)), strict=True):
                if _tie(hashlib.blake2b(s.tobytes(), digest_size=16).digest()) != b_tie:
                    continue  # another row of that id
                if (a_id, a_tie) == (b_id, b_tie):
                    group, pivot = (a_id, a_tie, salt), s
                elif group == (a_id, a_tie, salt):
                    place = np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)
                    if rule.holds(int(np.count_nonzero(pivot[place] == s)), len(pivot), len(s)):
                        out.append((a_id, a_tie, b_id, b_tie))
            yield common.table(**{k: pa.array([o[i] for o in out], pa.int64()) for i, k in enumerate(("a_id", "a_tie", "b_id", "b_tie"))})

    return run


def _plausible(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in (4, 5, 6, 7))
            ok = [differing(s, t) <= a + b - 2 * rule.both(a, b) for a, b, s, t in zip(n, m, x, y, strict=True)]
            yield batch.select(list(range(4))).filter(pa.array(ok, pa.bool_()))

    return run


def plausible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sketches do not rule a link out."""
    for p in "ab":
        pairs = pairs.join(nodes.select(F.col("id").alias(f"{p}_id"), F.col("tie").alias(f"{p}_tie"), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch")), [f"{p}_id", f"{p}_tie"])
    return pairs.select("a_id", "a_tie", "b_id", "b_tie", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(_plausible(rule), PAIR)


def only(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The rows whose id is in a Bloom filter of the ids, which spares most others the way to the join that follows; and the filter, to be destroyed.

    The filter's size follows the number of ids up to BLOOM bits, whatever they are; beyond that it lets more rows through.
    """
    spark = rows.sparkSession
    ids = ids.select("id").distinct()
    bits = 1 << min(BLOOM, max(16, (16 * ids.count()).bit_length()))
    h = F.xxhash64("id")
    places = ids.select(F.explode(F.array(*(F.pmod(F.shiftrightunsigned(h, k), F.lit(bits)) for k in (0, 31)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toPandas()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    kept = spark.sparkContext.broadcast(table)
    found = rows.select("id", "text", F.pmod(h, F.lit(bits)).alias("p"), F.pmod(F.shiftrightunsigned(h, 31), F.lit(bits)).alias("q")).mapInArrow(_only(kept), "id long, text string")
    return found, kept


def _only(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept.value
        for batch in batches:
            if batch.num_rows:
                p, q = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
                ok = ((table[p >> 6] >> (p & 63)) & (table[q >> 6] >> (q & 63)) & 1).astype(bool)
                yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def verified(pairs: DataFrame, rows: DataFrame, n: int, rule: Rule) -> DataFrame:
    """Those of the distinct pairs whose whole sets are similar, as a saved table. rows: id and text of all documents.

    Pivots are the nodes with more partners, and each one's partners come to it, by SPOKES at a time.
    """
    spark = pairs.sparkSession
    degree = pairs.groupBy("a_id", "a_tie").agg(F.count(F.lit(1)).alias("degree"))
    dealt = pairs.join(degree, ["a_id", "a_tie"]).withColumn("parts", F.ceil(F.col("degree") / SPOKES)).withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b_id", "b_tie"), F.col("parts"))).otherwise(F.lit(0)))
    spokes = dealt.select("a_id", "a_tie", "salt", F.col("b_id").alias("id"), F.col("b_tie").alias("tie"))
    pivots = degree.select("a_id", "a_tie", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("degree") / SPOKES) - 1)).alias("salt"), F.col("a_id").alias("id"), F.col("a_tie").alias("tie"))
    wanted = spokes.unionByName(pivots)
    found, bloom = only(rows, wanted)
    texts = wanted.join(found, "id").select("a_id", "a_tie", "salt", "id", "tie", "text")
    first = F.when((F.col("a_id") == F.col("id")) & (F.col("a_tie") == F.col("tie")), 0).otherwise(1)
    ordered = texts.repartition(common.parts(spark, 2 * pairs.count(), TEXTS), "a_id", "a_tie", "salt").sortWithinPartitions("a_id", "a_tie", "salt", first)
    out = common.save(ordered.mapInArrow(_verify(n, rule), PAIR))
    bloom.destroy()
    return out


def components(links: DataFrame) -> DataFrame:
    """id, tie, c_id, c_tie: for each node of the links the least node that it is connected with.

    Large star and small star in turn, each round written to the shared folder, until nothing changes.
    """
    node = lambda p: F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_tie").alias("tie"))
    edges = links.select(F.greatest(node("a"), node("b")).alias("u"), F.least(node("a"), node("b")).alias("v")).filter("u != v").distinct()
    edges, before = common.save(edges), None
    while True:
        old = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        edges = common.save(edges)
        common.discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u.id").alias("id"), F.col("u.tie").alias("tie"), F.col("v.id").alias("c_id"), F.col("v.tie").alias("c_tie"))
        before = now


def unsettled(members: DataFrame, nodes: DataFrame, parts: DataFrame, tested: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """The pairs of a list's members that are in different components and were not compared yet: each member outside the list's largest component with all others."""
    m = members.join(parts, list(NODE), "left").select("element", *NODE, "n", "pos", F.when(F.col("c_id").isNull(), F.struct(F.col("id").alias("c_id"), F.col("tie").alias("c_tie"))).otherwise(F.struct("c_id", "c_tie")).alias("c"))
    counts = m.groupBy("element", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("element").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    m = m.join(counts.select("element", "main"), "element").join(nodes.select(*NODE, "brief"), list(NODE))
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(-math.log(rule.num / rule.den))) if rule.num < rule.den else F.col("n")
    m = common.save(m.select("element", *NODE, "n", "pos", "c", "main", band.cast("long").alias("band"), *(F.col("brief")[k].alias(f"s{k}") for k in range(BRIEF))))
    # partners have like sizes, so they are in one band or in neighbouring ones
    few = m.filter("c != main").select("element", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"), F.col("id").alias("x_id"), F.col("tie").alias("x_tie"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("c").alias("x_c"), *(F.col(f"s{k}").alias(f"x_s{k}") for k in range(BRIEF)))
    size = (F.lit(rule.num) * F.col("n") <= F.lit(rule.den) * F.col("x_n")) & (F.lit(rule.num) * F.col("x_n") <= F.lit(rule.den) * F.col("n")) & (F.greatest("n", "x_n") >= boundary)
    left = F.lit(rule.num + rule.den) * F.least(F.col("n") - F.col("pos"), F.col("x_n") - F.col("x_pos")) >= F.lit(rule.num) * (F.col("n") + F.col("x_n"))
    # what the sketches differ in, two sets differ in at least; what a link lets differ is (den - num) / (den + num) of their sizes
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"x_s{k}"))) for k in range(1, BRIEF)), F.bit_count(F.col("s0").bitwiseXOR(F.col("x_s0"))))
    near = F.lit(rule.num + rule.den) * apart <= F.lit(rule.den - rule.num) * (F.col("n") + F.col("x_n"))
    found = few.join(m, ["element", "band"]).filter((F.col("c") != F.col("x_c")) & size & left & near)
    x, y = F.struct(F.col("x_id").alias("id"), F.col("x_tie").alias("tie")), F.struct("id", "tie")
    pairs = found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).select(F.col("a.id").alias("a_id"), F.col("a.tie").alias("a_tie"), F.col("b.id").alias("b_id"), F.col("b.tie").alias("b_tie")).distinct()
    out = common.save(pairs.join(tested, pairs.columns, "left_anti"))
    common.discard(m)
    return out


def _joined(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """id and text of all rows; their sets; the nodes (distinct sets with an id); and the component of each node that has a link."""
    spark, rule = docs.sparkSession, Rule(num, den)
    common.tune(spark)
    rows = common.two(docs, id_col, text_col)
    counts = rows.mapInArrow(_frequent(n), "element long, size long, n long").groupBy("element", "size").agg(F.sum("n").alias("n"))
    told = common.save(counts.filter(F.col("size").isNotNull() | (F.col("n") >= OFTEN_IN_ALL)))
    boundary = boundary_of([(r.size, r.n) for r in told.filter("size is not null").select(F.col("size").cast("int").alias("size"), "n").collect()], rule)
    often = told.filter("element is not null").orderBy(F.desc("n"), "element").limit(FREQUENT).select("element").toPandas()  # FREQUENT rows at most
    known = often["element"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known, kind="stable")
    frequent = spark.sparkContext.broadcast((known[order], len(known) - order))  # the most frequent rank highest
    sets = common.save(rows.mapInArrow(_sets(n, rule, boundary, frequent), SETS))
    frequent.destroy()
    nodes = sets.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("tie").alias("tie"), F.max("n").alias("n"), F.min_by(F.struct("entries", "sizes", "checks", "sketch", "brief"), "id").alias("e"))
    nodes = common.save(nodes.select("key", "id", "tie", "n", "e.*"))
    total = sets.agg(F.sum(F.octet_length("entries") / 8)).first()[0] or 0
    slim = common.save(sets.select("id", "n", "key"))
    common.discard(told, sets)
    buckets = common.parts(spark, int(total), BUCKET)
    posts = nodes.select("id", "tie", "n", "entries", "sizes", "checks").mapInArrow(_posts(buckets, rule, boundary), POSTED)
    made = common.save(posts.groupBy("bucket").applyInArrow(_lists(rule, boundary), POSTED), codec="none")
    nodes_slim = common.save(nodes.drop("entries", "sizes", "checks"))
    common.discard(nodes)
    common.settle(spark)
    nodes = nodes_slim
    of = lambda kind, names, schema: made.filter(F.col("kind") == kind).select("payload").mapInArrow(_unpack(names), schema)
    pairs = common.save(of(PAIRS, ("a_id", "a_tie", "b_id", "b_tie"), PAIR).distinct())
    near = common.save(plausible(pairs, nodes, rule))
    links = verified(near, rows, n, rule)
    common.settle(spark)
    parts = components(links)
    left = unsettled(of(MEMBERS, MEMBER, "element long, id long, tie long, n long, pos long"), nodes, parts, pairs, rule, boundary)
    common.discard(made, pairs, near)
    near = common.save(plausible(left, nodes, rule))
    slim_nodes = common.save(nodes.select("key", *NODE, "n"))
    common.discard(left, nodes)
    common.settle(spark)
    more = verified(near, rows, n, rule)
    common.discard(near)
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    common.discard(links, more)
    common.settle(spark)
    return rows, slim, slim_nodes, parts


def similar_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest id that links lead to, its own included).

    Documents link when the Jaccard similarity of their sets of n-word shingles is num / den or more; a text of fewer words is
    one shingle; null texts and texts without words have no shingles and link with nothing. Equal sets are one node. A row
    without an id takes the component of its set, or null where no row with that set has an id. Repeated rows and ids stay,
    each by its own text. An empty table gives no rows; other columns play no part.
    """
    _, sets, nodes, parts = _joined(docs, n, num, den, id_col, text_col)
    return _grouped_rows(sets, nodes, parts)


def _grouped_rows(sets: DataFrame, nodes: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_shingles, component_id, and more columns of nodes."""
    found = nodes.select("key", "id", "tie", *more).join(parts, list(NODE), "left").select("key", F.coalesce("c_id", "id").alias("component_id"), *more)
    return sets.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "key").join(found, "key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)


#: Members of a component that are compared as one block, and the shared elements whose columns are multiplied at once.
BLOCK, COLUMNS = 256, 4096


def shared(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """How many elements the sets have in common: each with each, or those before split with those from it on."""
    count = np.array([len(s) for s in sets])
    row, element = np.repeat(np.arange(len(sets)), count), np.concatenate(sets)
    keep = again(element)
    row, column = row[keep], np.unique(element[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cut = len(sets) if split is None else split
    out = np.zeros((cut, len(sets) - (split or 0)), np.int64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (c, c + COLUMNS)))
        has = np.zeros((len(sets), COLUMNS), np.float32)  # sums of ones, exact
        has[row[part], column[part] - c] = 1
        out += (has[:cut] @ has[split or 0 :].T).astype(np.int64)
    return out


def _count_links(n: int, rule: Rule):
    """Rows come by component and pair of blocks; gives for each member its links there, counted by the rows that have the other's set."""

    def counted(group: tuple, members: list[tuple]) -> list[tuple[int, int, int]]:
        first, second = group[2:]
        members.sort(key=lambda m: m[3])
        split = None if first == second else sum(m[3] == first for m in members)
        sets, rows = [m[4] for m in members], np.array([m[2] for m in members], np.int64)
        size = np.array([len(s) for s in sets])
        both = shared(sets, split)
        a, b = (slice(None), slice(None)) if split is None else (slice(None, split), slice(split, None))
        links = rule.holds(both, size[a][:, None], size[b][None])
        if split is None:
            np.fill_diagonal(links, False)
            found = links @ rows
        else:
            found = np.concatenate([links @ rows[b], links.T @ rows[a]])
        return [(m[0], m[1], int(k)) for m, k in zip(members, found, strict=True) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        group, members, out = None, {}, []
        for batch in batches:
            sets = shingle_sets(batch.column(8), n)
            for s, c_id, c_tie, p, q, i, tie, block, weight in zip(sets, *(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if _tie(hashlib.blake2b(s.tobytes(), digest_size=16).digest()) != tie:
                    continue  # another row of that id
                if group != (c_id, c_tie, p, q):
                    if len(members) > 1:
                        out += counted(group, list(members.values()))
                    group, members = (c_id, c_tie, p, q), {}
                members[i, tie] = (i, tie, weight, block, s)
            yield common.table(**{k: pa.array([o[j] for o in out], pa.int64()) for j, k in enumerate(("id", "tie", "k"))})
            out = []
        if len(members) > 1:
            out = counted(group, list(members.values()))
            yield common.table(**{k: pa.array([o[j] for o in out], pa.int64()) for j, k in enumerate(("id", "tie", "k"))})

    return run


def similar_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As similar_groups, with n_links: how many other rows with an id link with the row, those with an equal set among them.

    Links lie within components, so the distinct sets of each component are all compared exactly, by blocks in large ones.
    """
    rows, sets, nodes, parts = _joined(docs, n, num, den, id_col, text_col)
    spark, rule = docs.sparkSession, Rule(num, den)
    weights = sets.filter("n > 0 and id is not null").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    nodes = common.save(nodes.select("key", *NODE).join(weights, "key"))
    # a component's least node has no row of its own in parts
    members = parts.unionByName(parts.select(F.col("c_id").alias("id"), F.col("c_tie").alias("tie"), "c_id", "c_tie").distinct())
    sizes = members.groupBy("c_id", "c_tie").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = members.join(nodes.select(*NODE, "rows"), list(NODE)).join(sizes, ["c_id", "c_tie"]).withColumn("block", F.pmod(F.xxhash64(*NODE), F.col("blocks")))
    # a block meets each block, itself among them, once
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("p"), F.greatest(o, "block").alias("q")))).alias("pair")
    members = common.save(members.select("c_id", "c_tie", *NODE, "block", "rows", "blocks"))
    few, bloom = only(rows, members)
    texts = members.join(few, "id").select("c_id", "c_tie", *NODE, "block", "rows", "text", pair)
    group = ["c_id", "c_tie", "p", "q"]
    dealt = texts.select("c_id", "c_tie", "pair.p", "pair.q", *NODE, "block", "rows", "text").repartition(common.parts(spark, members.agg(F.sum("blocks")).first()[0] or 0, TEXTS), *group).sortWithinPartitions(*group)
    counts = dealt.mapInArrow(_count_links(n, rule), "id long, tie long, k long").groupBy(*NODE).agg(F.sum("k").alias("k"))
    nodes = common.save(nodes.join(counts, list(NODE), "left").select("key", *NODE, (F.col("rows") + F.coalesce("k", F.lit(0))).alias("k")))
    bloom.destroy()
    common.discard(members)
    found = _grouped_rows(sets, nodes, parts, "k")
    # the row itself is one of those that have its set
    return found.select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNull(), F.coalesce("k", F.lit(0))).otherwise(F.coalesce(F.col("k") - 1, F.lit(0))).cast("long").alias("n_links"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)


def op4_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_links(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
