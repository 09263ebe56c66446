"""License scans by conditional compression.

Blocks around words that licenses use, the line and then what stands around over line ends, are compressed alone and with each template as raw zstandard dictionary. Templates are
tried in the order of what they save; the first one whose wording the block has, but for few words and no telling one (a number, a name), wins.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# Notices of public licenses, several wordings each.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words (lower case) that make a place worth a look.
CUES = ("licens", "licenc", "permission is hereby", "redistribution and use", "public domain", "creative commons", "waived all copyright")
#: The cues as they stand in lower-case text: line ends and comment marks may part their words.
CUE_RES = [re.compile(cue.replace(" ", "[^a-z0-9]{1,40}")) for cue in CUES]
CUE_BYTES = [re.compile(cue.replace(" ", "[^a-z0-9]{1,160}").encode()) for cue in CUES]
#: Characters of a line's block before and after a cue; least saving; share of a template's words that may differ.
BEFORE, AFTER, LEAST_SAVING, MOST_DIFFERENT = 160, 240, 0.25, 0.2
#: A block over several lines has so many times the longest template's length on each side of the cue, for indents and comment marks.
WIDER = 2
#: What wrapped lines have between them: comment marks and white space.
LINE_END = re.compile(r"[^\S\n]*\n(?:[\s*/#;%!>|\"'-]|//|rem\b|dnl\b)*", re.ASCII | re.IGNORECASE)
PIECE = re.compile(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)*")


def pieces(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in PIECE.finditer(text)]


class Compressors:
    """One without and one for each template as dictionary."""

    def __init__(self, templates: list[tuple[str, str]]):
        import zstandard as z

        plain = {"level": 19, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.templates = templates
        self.reach = WIDER * max((len(t) for _, t in templates), default=0)
        self.alone = z.ZstdCompressor(**plain)
        self.primed = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), **plain) for _, t in templates]
        self.words = [[w for w, *_ in pieces(t)] for _, t in templates]
        # numbers, and words that hardly any other license has, must not differ
        of: dict[str, set[str]] = {}
        for (name, _), words in zip(templates, self.words, strict=True):
            for w in words:
                of.setdefault(w, set()).add(name)
        self.telling = [{w for w in words if w[0].isdigit() or len(of[w]) == 1 and len(words) <= 10} for words in self.words]
        # words of short notices that hardly any other license has: a span with one is not another license's
        names = {w for words in self.words if len(words) <= 13 for w in words if len(of[w]) == 1 and not w[0].isdigit()}
        self.foreign = [names - {w for (n, _), words in zip(templates, self.words, strict=True) if n == name for w in words} for name, _ in templates]

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """What each template saves, as a share of its own size at most, the largest first."""
        raw = block.encode("utf-8", "replace")
        size = len(self.alone.compress(raw))
        return sorted(((size - len(p.compress(raw))) / max(1, len(t)), -i) for i, (p, (_, t)) in enumerate(zip(self.primed, self.templates, strict=True)))[::-1]


def wording(block: list[tuple[str, int, int]], template: list[str], telling: set[str]) -> tuple[int, int, int] | None:
    """Where the template's words stand in the block, and how many words differ; None if too many do, or a telling one."""
    match = difflib.SequenceMatcher(None, [w for w, *_ in block], template, autojunk=False)
    runs = [m for m in match.get_matching_blocks() if m.size]
    if not runs:
        return None
    # the region that ends where the template's last word would, without stray words far from the longest run
    best = max(runs, key=lambda m: m.size)
    runs = [m for m in runs if abs((m.a - m.b) - (best.a - best.b)) <= MOST_DIFFERENT * len(template)]
    a, b, same = runs[0].a, runs[-1].a + runs[-1].size, sum(m.size for m in runs)
    different = max(len(template) - same, b - a - same)
    found = {w for w, *_ in block[a:b]}
    if different > MOST_DIFFERENT * len(template) or telling - found:
        return None
    return block[a][1], block[b - 1][2], different


def placed(words: list[tuple[str, int, int]], c: Compressors, i: int, at: int, end: int) -> tuple[int, int, int] | None:
    """As wording, of the notice that has the cue at at:end and no other license's name; others in the block are left out."""
    while w := wording(words, c.words[i], c.telling[i]):
        if w[0] < end and at < w[1]:
            return None if any(w[0] <= a < w[1] and x in c.foreign[i] for x, a, _ in words) else w
        words = [x for x in words if x[1] >= w[1]] if w[1] <= at else [x for x in words if x[2] <= w[0]]
    return None


def scan_text(text: str, c: Compressors) -> list[tuple[int, int, str, int]]:
    """Start, end, license and differing words of each notice, in order; of overlapping ones the one with fewer differences, then the longer."""
    low, places = text.lower(), []
    if len(low) != len(text):  # a few letters grow in lower case
        low = "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)
    for cue in CUE_RES:
        places += [(m.start(), m.end()) for m in cue.finditer(low)]
    found = []
    for at, end in sorted(places):
        begin = max(text.rfind("\n", 0, at) + 1, at - BEFORE)
        stop = text.find("\n", end)
        stop = min(len(text) if stop < 0 else stop, end + AFTER)
        for begin, stop in ((begin, stop), (max(0, at - c.reach), min(len(text), end + c.reach))):
            block = text[begin:stop]
            words = pieces(block)
            exact = False
            for saving, i in c.ranked(LINE_END.sub(" ", block)):
                if saving < LEAST_SAVING:
                    break
                if w := placed(words, c, -i, at - begin, end - begin):
                    found.append((begin + w[0], begin + w[1], c.templates[-i][0], w[2]))
                    if exact := not w[2]:
                        break
            if exact:
                break
    out: list[tuple[int, int, str, int]] = []
    for s in sorted(set(found), key=lambda s: (s[3], s[0] - s[1], s)):
        if all(s[1] <= o[0] or o[1] <= s[0] for o in out):
            out.append(s)
    return sorted(out)


def suspects(column: pa.Array) -> np.ndarray:
    data, offs = common.text_bytes(column)
    low, at = common.LOWER[data].tobytes(), []
    for cue in CUE_BYTES:
        at += [m.start() for m in cue.finditer(low)]
    return np.unique(np.searchsorted(offs, np.array(at, np.int64), "right") - 1)


SCANNED = "doc_id long, n_licenses long, licenses string, spans string"


def _scan(templates: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(templates)
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            rows = suspects(batch.column(1))
            for i, text in zip(rows.tolist(), batch.column(1).take(pa.array(rows)).to_pylist(), strict=True):
                found[i] = scan_text(text or "", c)
            names = [",".join(sorted({s[2] for s in f})) for f in found]
            spans = [",".join(f"{n}:{a}:{b}:{d}" for a, b, n, d in f) for f in found]
            yield common.table(doc_id=batch.column(0), n_licenses=np.array([len(f) for f in found], np.int64), licenses=pa.array(names, pa.string()), spans=pa.array(spans, pa.string()))

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: the number of notices, the licenses (sorted), and the notices as license:start:end:differing words.

    Places are code points, the end exclusive. Null or empty text has none; null ids and repeated rows stay; an empty table
    gives no rows; other columns play no part. Whole texts are scanned.
    """
    common.tune(docs.sparkSession)
    return common.two(docs, id_col, text_col).mapInArrow(_scan(templates), SCANNED)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
