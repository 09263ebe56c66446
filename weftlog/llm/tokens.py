"""Fast exact tokenization with the `tokenizers` library: each distinct word is encoded once per worker.

The vocabulary file in use lower-cases, composes (NFC) and then cuts at white space and between letters, digits and symbols
before any merge, so a text's ids are those of its pieces one after another. Texts are cut by the byte in numpy, pieces are told
apart by Arrow's dictionary encoding, and what is new goes to the library. Pieces are kept in a table of a worker, bounded by
bytes (MEMO, or as many as asked for; when half is full, what was not met since the last time goes, which costs time and never
changes ids). A file whose tokenizer does not work that way is found out by PROBE, and its texts are encoded
whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

MEMO = 96 << 20
#: Bytes of an entry of the table beside its piece and its ids: two objects, and its place in the dictionary.
ENTRY = 150
#: Texts by which a file shows whether it cuts and lower-cases as said above.
PROBE = (
    "Plain words, and more. Then UPPER case\nand a new line",
    "x1 22 333 4,5 a.b (c) don't it's #tag $9 50% a_b a-b",
    "Éa\u0301ß Ünï İΣς 日本 한글 🙂 \u200d  two  blanks ",
    "tab\there\r\nand ... !? <|x|> ~~",
    "a,.b C..d 12ab34 [X]{y}`^\\=+/@:;\"* ÀÈ,é ##Ö## a|b || p>q &r É1é 7.5% http://a.b/C?d=1",
)
#: Kinds of UTF-8 bytes. Between blanks, what has letters, digits and symbols only can be lower-cased and cut beforehand: a run of
#: letters, a digit, and a run of symbols is a piece each. With any other byte it is hard: one piece, as it stands.
BLANK, LETTER, DIGIT, SYMBOL, HARD = range(5)
#: ASCII letters, and letters that are composed already and whose lower case is one letter: those that begin with C3, where C3 97
#: and C3 B7 are signs. Apostrophes start pieces of their own, and `<` a special token.
LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, *(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))])
KIND = np.full(256, HARD, np.uint8)
KIND[[x for x in range(33, 127) if x not in b"'<"]] = SYMBOL
KIND[list(b"0123456789")] = DIGIT
KIND[list(LETTERS)] = LETTER
KIND[list(b" \n")] = BLANK
LOWER = common.LOWER.copy()
LOWER[0x80:0x9F] += 32  # behind C3: the letters from C3 80 to C3 9E
LOWER[0x97] = 0x97
#: Parts the words that are encoded in one call; no run of letters has it.
MARK = "|"
#: Bytes that are cut at once, and what runs on to the next blank or text.
STRETCH = 4 << 20


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def stretches(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts the bytes of texts into parts of about STRETCH bytes, at blanks or between texts."""
    a = 0
    while a < len(data):
        b = min(a + STRETCH, len(data))
        end = int(offs[np.searchsorted(offs, b)])
        while b < end:
            found = np.flatnonzero(KIND[data[b : min(end, b + STRETCH)]] == BLANK)
            if len(found):
                end = b + int(found[0])
            b = min(end, b + STRETCH)
        yield a, b
        a = b


def cut(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where pieces start, and the pieces; first: where texts start."""
    kind = KIND[data]
    solid = kind != BLANK
    hard = np.flatnonzero(kind == HARD)
    low = LOWER[data]
    if len(hard):
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        begin[first] = solid[first]
        at = np.flatnonzero(begin)
        whole = np.zeros(len(at), bool)
        whole[np.searchsorted(at, hard, "right") - 1] = True
        stay = np.zeros(len(data), bool)
        stay[at[0] :] = np.repeat(whole, np.diff(at, append=len(data)))
        stay &= solid
        kind[stay] = HARD
        low[stay] = data[stay]
    new = kind == DIGIT
    new[1:] |= kind[1:] != kind[:-1]
    new[:1] = True
    new[first] = True
    new &= solid
    body = low[solid]
    ends = np.append(np.flatnonzero(new[solid]), len(body)).astype(np.int32)
    return np.flatnonzero(new), pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)])


class WordTokenizer:
    """ids(texts) gives for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        #: The same model (in memory once) for pieces that are cut and lower-cased already.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: The ids of pieces seen lately, and of those before; what is met again moves to the former.
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.most, self.size, self.by_word = most, 0, True
        marks = self.bare.encode(MARK, add_special_tokens=False).ids
        self.mark = marks[0] if marks else -1
        try:
            self.by_word = len(marks) == 1 and self.ids(list(PROBE)) == self.whole(list(PROBE))
        except ValueError:  # a mark that merges with its neighbours parts no words
            self.by_word = False

    def whole(self, texts: list[str | None]) -> list[bytes]:
        """The library's own ids, text by text."""
        return [packed(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        words = [w for w in pieces if not w.translate(None, LETTERS)]
        rest = [w for w in pieces if w.translate(None, LETTERS)]
        lines = [f" {MARK} ".join(b"\n".join(words[i : i + 128]).decode().split("\n")) for i in range(0, len(words), 128)]
        for k, e in enumerate(self.bare.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(ids == self.mark) * 4).tolist()
            raw, at = ids.tobytes(), 0
            ends.append(len(raw))
            for w, end in zip(words[128 * k : 128 * k + 128], ends, strict=True):
                self.memo[w] = raw[at:end]
                at = end + 4
            self.size += (ENTRY + 4) * len(ends) + len(raw) + len(lines[k])
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.memo[w] = ids = packed(e.ids)
            self.size += ENTRY + len(w) + len(ids)

    def pieces(self, kinds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after another, and how many each has."""
        if self.size > self.most // 2:
            self.old, self.memo, self.size = self.memo, {}, 0
        new = [w for w in kinds if w not in self.memo]
        again = {w: self.old[w] for w in new if w in self.old}
        self.memo |= again
        self.size += sum(map(len, again)) + sum(map(len, again.values())) + ENTRY * len(again)
        self.learn([w for w in new if w not in again])
        raw = list(map(self.memo.__getitem__, kinds))
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) >> 2

    def flat(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the n + 1 offsets of the texts."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            raw = [x for i in range(0, len(column), 256) for x in self.whole(column.slice(i, 256).to_pylist())]
            return np.frombuffer(b"".join(raw), "<u4"), np.cumsum([0, *(len(x) >> 2 for x in raw)], dtype=np.int64)
        data, offs = common.text_bytes(column)
        out, at, total, done = [], np.zeros(len(offs), np.int64), 0, 0
        for a, b in stretches(data, offs):
            here = slice(done, done := int(np.searchsorted(offs, b)))
            first = offs[here] - a
            starts, cuts = cut(data[a:b], first)
            cuts = cuts.dictionary_encode()
            index = cuts.indices.to_numpy()
            ids, sizes = self.pieces(cuts.dictionary.to_pylist())
            each = sizes[index]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
            at[here] = total + ends[np.searchsorted(starts, first)]
            out.append(ids[np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], each) + np.arange(ends[-1])])
            total += int(ends[-1])
        at[done:] = total
        return np.concatenate(out) if out else np.zeros(0, "<u4"), at

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        ids, offs = self.flat(texts)
        raw, at = ids.astype("<u4", copy=False).tobytes(), (offs * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


_made: dict[str, WordTokenizer] = {}


def tokenizer(file: str, most: int = MEMO) -> WordTokenizer:
    """One for each file and worker process; its table, of about `most` bytes, outlives a task."""
    if file not in _made:
        _made[file] = WordTokenizer(file, most)
    _made[file].most = most
    return _made[file]


def forget() -> None:
    _made.clear()


def vocabulary_size(file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).get_vocab_size()
