"""Secret scans: patterns, then dictionary-primed zstandard novelty around sensitive words."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# The kinds of secrets, in the order in which spans of one start are listed, and their patterns.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Words that make a context sensitive (lower case), and what may stand between a string and an adjoining one that is in such a context.
SENSITIVE = ("password", "passwd", "secret", "token", "api", "akia", "key", "auth", "bearer", "credential", "passphrase", "pwd")
SENSITIVE_RE, BETWEEN = re.compile("|".join(SENSITIVE[:5] + SENSITIVE[6:]), re.ASCII | re.IGNORECASE), re.compile(r"(?:\\[rn]|[^A-Za-z0-9]){0,32}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=\-]{16,}")
#: The surrounding text on each side that may have the sensitive word and that primes the compressor, and the share of a string's bytes that must remain.
AROUND, REMAINS = 512, 0.92
#: Bytes that are compressed at once: zstandard leaves up to 63 literals as they are.
PIECE = 48
#: What stands before each piece, so that zstandard, which stores short blocks that save little, tells what the piece itself takes.
KNOWN = b"username password passphrase credentials certificate signature environment variable configuration production "
#: A dictionary, in lower case, of what code and configuration often hold, so that such identifiers compress away.
IDENTIFIERS = KNOWN + (
    "access_token refresh_token client_secret client_id api_key secret_key private_key public_key authorization bearer "
    "development staging database connection hostname localhost endpoint https://www. http:// example.com application/json "
    "content-type response request session cookie expires function return default import export const class static void "
    "string number boolean undefined null true false aws_access_key_id aws_secret_access_key database_url placeholder "
    "your-api-key-here changeme xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0123456789abcdef abcdefghijklmnopqrstuvwxyz "
    "documentation/reference/page.html account settings user profile service implementation controller manager factory handler "
    "builder provider repository project module package components folder bucket output release debug build source main java "
    "python lib site-packages node_modules index.js style.css getuser set create update delete find list valid permission "
    "content-length accept-encoding cache-control max_size timeout_seconds version beta server client usr local bin etc var home "
    "docs guide install search login test_ unicode kubernetes.io amazonaws.com github.com ubuntu linux windows amd64 x86_64 config "
    ".java .html .json .yaml .png 2024-01-01t00:00:00z v1/ v2/ 1.2.3 "
).encode()
#: Words of a tokenizer's vocabulary that join the dictionary: so many of the most frequent ones, of so many letters at least.
WORDS, LETTERS = 8_000, 4


@cache
def identifiers(file: str | None = None) -> bytes:
    """The dictionary, with words of a vocabulary (a tokenizers file) if one is given, the most frequent last, where they are cheapest."""
    if file is None:
        return IDENTIFIERS
    vocabulary = json.loads(Path(file).read_text())["model"]["vocab"]
    words = (re.sub(r"^\W+|</w>$", "", w).lower() for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]))
    kept = [w for w in dict.fromkeys(words) if len(w) >= LETTERS and w.isascii() and w.isalpha()][:WORDS]
    return " ".join(kept[::-1]).encode() + b" " + IDENTIFIERS


HEX_BYTES = common.byte_class(b"0123456789abcdef")


def novelty(text: str, start: int, end: int, known: bytes = IDENTIFIERS) -> float:
    """Compressed bytes that text[start:end] adds, a byte of it, where dictionary and surroundings, but for copies of it, are known.

    All in lower case, since identifiers join words in every case. The string is compressed by pieces that are too short for
    zstandard to code letters by frequency, each with what stands before it as known, so that only matches save bytes and
    random strings of few letters remain whole at every length.
    """
    import zstandard as z

    part, far = text[start:end], AROUND + end - start
    around = known + (text[max(0, start - far) : start].replace(part, " ")[-AROUND:] + " " + text[end : end + far].replace(part, " ")[:AROUND]).lower().encode("utf-8", "replace")
    raw, added = part.lower().encode(), 0
    size = -(-len(raw) // -(-len(raw) // PIECE))
    settings = z.ZstdCompressionParameters.from_level(9, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False)
    for i in range(0, len(raw), size):
        primed = z.ZstdCompressor(compression_params=settings, dict_data=z.ZstdCompressionDict(around + b" " + raw[max(0, i - AROUND) : i], dict_type=z.DICT_TYPE_RAWCONTENT))
        added += len(primed.compress(KNOWN + raw[i : i + size])) - len(primed.compress(KNOWN))
    return added / len(raw)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]], known: bytes = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Strings of 16 characters and more with a digit and a letter, near a sensitive word, outside the base spans, that hardly compress; and all copies of those.

    Near is AROUND characters before or behind, or next to a string that is near, as the lines of a key are.
    """
    words = [(m.start(), m.end()) for m in SENSITIVE_RE.finditer(text)]
    if not words:
        return []
    starts, ends = np.array(words).T
    found = [(m.start(), m.start() + len(m[0].rstrip(".=-"))) for m in CANDIDATE.finditer(text)]
    among = lambda a, b: np.searchsorted(starts, b, "right") - np.searchsorted(ends, a)
    inside = lambda a, b: max(0, np.searchsorted(ends, b, "right") - np.searchsorted(starts, a))
    near = [bool(among(a - AROUND, b + AROUND) > inside(a, b)) for a, b in found]
    for order in (range(1, len(found)), range(len(found) - 2, -1, -1)):
        step = order.step
        for i in order:
            x, y = sorted((i - step, i))
            near[i] = near[i] or (near[i - step] and BETWEEN.fullmatch(text, found[x][1], found[y][0]) is not None)
    begins, reach = [x for x, _, _ in base], np.maximum.accumulate([0, *(y for _, y, _ in base)])
    novel, seen = set(), []
    for (a, b), is_near in zip(found, near, strict=True):
        if b - a < 16 or reach[np.searchsorted(begins, b)] > a:
            continue
        part = text[a:b]
        if not (re.search(r"[0-9]", part) and re.search(r"[A-Za-z]", part)):
            continue
        seen.append((a, b))
        if is_near and part not in novel and novelty(text, a, b, known) >= REMAINS:
            novel.add(part)
    return [(a, b, "novel") for a, b in seen if text[a:b] in novel]


def spans_of(text: str, known: bytes = IDENTIFIERS) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, known), key=lambda s: (s[0], KINDS.index(s[2])))


def suspects(column: pa.Array) -> np.ndarray:
    """The rows that may have spans: those with a run of 32 hexadecimal digits or one of the sensitive words."""
    data, offs = common.text_bytes(column)
    starts, ends, _ = common.runs(HEX_BYTES[data], offs)
    at = [starts[ends - starts >= LEAST["hex"]]]
    low = common.LOWER[data].tobytes()
    for word in SENSITIVE:
        w, found, i = word.encode(), [], -1
        while (i := low.find(w, i + 1)) >= 0:
            found.append(i)
        at.append(np.array(found, np.int64))
    return np.unique(np.searchsorted(offs, np.concatenate(at), "right") - 1)


def find(column: pa.Array, known: bytes) -> dict[int, list[tuple[int, int, str]]]:
    """Row number -> spans, for the rows that have any."""
    texts = column.take(pa.array(rows := suspects(column)))
    found = {int(i): spans_of(t, known) for i, t in zip(rows, texts.to_pylist(), strict=True) if t}
    return {i: s for i, s in found.items() if s}


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _scan(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            found = find(batch.column(1), identifiers(vocabulary))
            rows = [found.get(i, []) for i in range(batch.num_rows)]
            counts = {f"n_{k}": pa.array([sum(s[2] == k for s in r) for r in rows], pa.int64()) for k in KINDS}
            shas = [hashlib.sha256(listed([s for s in r if s[2] != "novel"]).encode()).hexdigest() for r in rows]
            yield common.table(doc_id=batch.column(0), **counts, base_sha256=pa.array(shas, pa.string()), spans=pa.array([listed(r) for r in rows], pa.string()))

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A row for each row of docs: counts of spans by kind, the digest of the patterns' spans, and all spans.

    Null or empty text has no spans (the digest is that of the empty string); null ids and repeated rows stay; an empty table
    gives no rows; other columns play no part. Whole texts are scanned, however long. vocabulary: a tokenizers file whose words
    are no secrets.
    """
    common.tune(docs.sparkSession)
    return common.two(docs, id_col, text_col).mapInArrow(_scan(vocabulary), SCANNED)


REDACTED = "[REDACTED]"


def _redact(at: int, chars: int | None, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            column = batch.column(at)
            if found := find(column, identifiers(vocabulary)):
                texts = column.to_pylist()
                for i, spans in found.items():
                    t, out, done = texts[i], [], 0
                    for a, b, _ in spans:
                        if a >= done:
                            out += [t[done:a], REDACTED]
                        done = max(done, b)
                    texts[i] = "".join(out) + t[done:]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, column.type)
                if chars is not None:
                    sizes = columns[chars].to_pylist()
                    for i in found:
                        sizes[i] = len(texts[i])
                    columns[chars] = pa.array(sizes, columns[chars].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return run


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs with each secret replaced by a mark (overlapping ones by one); chars_col, if given, gets the new length of changed texts.

    All rows and columns stay; rows without secrets, null texts among them, are as they were.
    """
    common.tune(docs.sparkSession)
    return docs.mapInArrow(_redact(docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col else None, vocabulary), docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
