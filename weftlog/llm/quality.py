"""Quality rules: counts of words and symbols, and repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# The base rules.
SYMBOLS = common.byte_class(b"#*$%&|<>")
LEAST_WORDS, WINDOW, MOST_REPEAT = 50, 3, (50, 100)
#: Shares of a text's word characters that may lie inside n-grams (of so many words) which occur again in it: far above what
#: one line at the head and the foot of a short text makes.
COVERAGE = {5: 0.40, 7: 0.35, 10: 0.30}
#: The same for repeated lines (later copies), by lines and by characters; and symbols a word.
MOST_DUP_LINES, MOST_DUP_LINE_CHARS, MOST_SYMBOLS = 0.50, 0.30, 0.25
NEWLINE = common.byte_class(b"\n")


def again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    out = np.zeros(len(keys), bool)
    if len(twice):
        table, low = np.zeros(1 << 20, bool), np.uint64((1 << 20) - 1)
        table[twice & low] = True
        maybe = np.flatnonzero(table[keys & low])
        place = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
        out[maybe[twice[place] == keys[maybe]]] = True
    return out


def covered(flags: np.ndarray, n: int, total: int) -> np.ndarray:
    """The words inside the n-word windows that are flagged at their first word."""
    out = np.zeros(total, bool)
    for k in range(n):
        out[k : k + len(flags)] |= flags
    return out


def by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


#: Bytes of text that are measured at once.
AT_ONCE = 1 << 20


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each row, as arrays."""
    parts = [_measure(part) for part in common.slices(column, AT_ONCE)] or [_measure(column)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    data, offs = common.text_bytes(column)
    starts, ends, first = common.runs(common.WORD[data], offs)
    words, rows = common.hash_words(data, starts, ends), len(offs) - 1
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[ends] - points[starts]
    bytes_first = offs
    own = common.mix(np.repeat(np.arange(1, rows + 1, dtype=np.uint64), np.diff(first)))  # keeps each row's n-grams apart
    out = {"n_words": np.diff(first), "word_chars": by_row(chars, first), "n_symbols": by_row(SYMBOLS[data], bytes_first)}
    for n in (WINDOW, *COVERAGE):
        keys, ok = common.gram_hashes(words, n), common.in_row(first, n, len(words))
        flags = np.zeros(len(keys), bool)
        if len(keys):
            at = np.flatnonzero(ok)
            flags[at] = again(keys[at] ^ own[at])
        inside = covered(flags, n, len(words))
        if n == WINDOW:
            out["n_repeat_words"] = by_row(inside, first)
        else:
            out[f"chars_{n}"] = by_row(np.where(inside, chars, 0), first)
    # lines: what lies between newlines, if it has a word
    a, b, lines = common.runs(~NEWLINE[data], offs)
    w = np.searchsorted(starts, a)
    full = (w < len(starts)) & (starts[np.minimum(w, max(0, len(starts) - 1))] < b) if len(starts) else np.zeros(len(a), bool)
    row_of = np.repeat(np.arange(rows), np.diff(lines))
    keys = common.hash_words(data, a, b) ^ common.mix(row_of.astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(full)
    _, one = np.unique(keys[at], return_index=True)
    later = np.ones(len(at), bool)
    later[one] = False
    dup = at[later]
    out["n_dup_lines"] = np.bincount(row_of[dup], minlength=rows)
    out["n_lines"] = np.bincount(row_of[at], minlength=rows)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars)])
    line_chars = before[np.searchsorted(starts, b)] - before[w]
    out["dup_line_chars"] = np.bincount(row_of[dup], weights=line_chars[dup], minlength=rows).astype(np.int64)
    n, total = out["n_words"], np.maximum(out["word_chars"], 1)
    out["base_failed"] = (n < LEAST_WORDS) | (MOST_REPEAT[1] * out["n_repeat_words"] > MOST_REPEAT[0] * n)
    bad = (out["n_dup_lines"] > MOST_DUP_LINES * out["n_lines"]) | (out["dup_line_chars"] > MOST_DUP_LINE_CHARS * total) | (out["n_symbols"] > MOST_SYMBOLS * n)
    for k, most in COVERAGE.items():
        bad |= out[f"chars_{k}"] > most * total
    out["kept"] = ~out["base_failed"] & ~bad
    return out


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
JUDGED = "doc_id long, " + ", ".join(f"{c} long" for c in LONGS) + ", base_failed boolean, kept boolean, repeat_coverage double"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.release()
    for batch in batches:
        m = measure(batch.column(1))
        most = np.max([m[f"chars_{n}"] for n in COVERAGE], axis=0) / np.maximum(m["word_chars"], 1)
        yield common.table(doc_id=batch.column(0), **{c: pa.array(m[c], pa.int64()) for c in LONGS}, base_failed=m["base_failed"], kept=m["kept"], repeat_coverage=most)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: the measures, whether the base rules fail, and the verdict.

    Null or empty text has no words, so it fails; null ids and repeated rows stay; an empty table gives no rows; other columns
    play no part. Whole texts are measured.
    """
    common.tune(docs.sparkSession)
    return common.two(docs, id_col, text_col).mapInArrow(_judge, JUDGED)


def _keep(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(at))["kept"]))

    return run


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that the rules keep."""
    common.tune(docs.sparkSession)
    return docs.mapInArrow(_keep(docs.columns.index(text_col)), docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
