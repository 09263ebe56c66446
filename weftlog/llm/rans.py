"""Token-id files under a static range asymmetric numeral system.

One frequency table is shared by all blocks. A block interleaves many lanes (token i goes to lane i modulo lanes), which
numpy advances together. Every CHECK steps the states of all lanes and the place in the stream are kept, so that several
readers can decode one block; each block has a CRC-32 and ends in known states.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES, CHECK = 2048, 256
#: States stay in [LOW, LOW << 32); a step reads or writes at most one 32-bit word.
LOW_BITS = 31
LOW, WORD_BITS, WORD_MASK = np.uint64(1 << LOW_BITS), np.uint64(32), np.uint64(0xFFFFFFFF)


def quantize(tokens: list[int], counts: list[int], bits: int) -> np.ndarray:
    """Frequencies (index: token id) that add up to 1 << bits, at least 1 for each token that occurs."""
    size = max(tokens, default=-1) + 1
    total, freq = 1 << bits, np.zeros(max(size, 1), np.uint64)
    if not tokens:
        return freq
    if len(tokens) > total:
        raise ValueError("more kinds of tokens than places in the table")
    have = np.asarray(counts, np.float64)
    part = np.maximum(1, np.floor(have * (total / have.sum()))).astype(np.int64)
    order, left = np.argsort(-have, kind="stable"), total - int(part.sum())
    while left:  # floors leave some over; ones that were raised may need some back
        for i in order:
            step = left if left > 0 else -min(-left, int(part[i]) - 1)
            part[i] += step
            left -= step
            if not left:
                break
    freq[np.asarray(tokens)] = part.astype(np.uint64)
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, tokens: np.ndarray, lanes: int = LANES) -> dict:
        n = len(tokens)
        lanes = max(1, min(lanes, n // 64))
        steps, shift, up = -(-n // lanes), np.uint64(self.bits), np.uint64(LOW_BITS + 32 - self.bits)
        f, c = self.freq[tokens], self.cum[tokens]
        if n and not f.all():
            raise ValueError("a token has no place in the frequency table")
        x, chunks, marks, size = np.full(lanes, LOW, np.uint64), [], [], 0
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            ff, xx = f[a:b], x[: b - a]
            full = xx >= (ff << up)
            if full.any():
                chunks.append((xx[full] & WORD_MASK).astype("<u4"))
                size += len(chunks[-1])
                xx = np.where(full, xx >> WORD_BITS, xx)
            q = xx // ff
            x[: b - a] = (q << shift) + (xx - q * ff) + c[a:b]
            if t % CHECK == 0:
                marks.append((t, size, x.copy()))
        stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        marks = [(t, size - s, states) for t, s, states in reversed(marks)] or [(0, 0, x)]
        payload = stream.tobytes()
        states = b"".join(s.astype("<u8").tobytes() for *_, s in marks)
        return {"n_tokens": n, "lanes": lanes, "mark_steps": [m[0] for m in marks], "mark_words": [m[1] for m in marks], "mark_states": states, "payload": payload, "crc32": zlib.crc32(states, zlib.crc32(payload))}

    def decode(self, block: dict, first: int = 0, last: int | None = None) -> np.ndarray:
        """The tokens from checkpoint number first up to checkpoint number last (none: to the end)."""
        if zlib.crc32(block["mark_states"], zlib.crc32(block["payload"])) != block["crc32"]:
            raise ValueError("a block's checksum is wrong")
        n, lanes, at = block["n_tokens"], block["lanes"], block["mark_steps"]
        begin, end = at[first], -(-n // lanes) if last is None or last >= len(at) else at[last]
        x = np.frombuffer(block["mark_states"], "<u8")[first * lanes : (first + 1) * lanes].astype(np.uint64)
        words, pos = np.frombuffer(block["payload"], "<u4").astype(np.uint64), block["mark_words"][first]
        out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
        mask, shift = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for t in range(begin, end):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            xx = x[: b - a]
            slot = xx & mask
            s = self.symbol[slot]
            xx = self.freq[s] * (xx >> shift) + slot - self.cum[s]
            low = xx < LOW
            k = int(np.count_nonzero(low))
            if k:
                xx[low] = (xx[low] << WORD_BITS) | words[pos : pos + k]
                pos += k
            x[: b - a] = xx
            out[a - begin * lanes : b - begin * lanes] = s
        if end == -(-n // lanes) and (pos != len(words) or (x != LOW).any()):
            raise ValueError("a block does not end in its first states")
        return out
