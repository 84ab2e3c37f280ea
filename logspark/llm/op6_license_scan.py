"""License scan by conditional compression.

Every whole text is searched for words that licence notices use. The words
around each, over line ends and comment marks, are candidate blocks (long ones
in overlapping windows, so that none is too long to compare). Each block is
compressed by zstandard plain, and with each licence's notices as raw
dictionary, which gives the relative reduction. Candidates are all licences
whose notices shorten the block; a short notice in a long block may not, so
the block's pieces of twice a notice's length are compressed alike before a
licence is given up. Candidates are confirmed by wording, the largest reduction
first: the words of a notice are aligned with the block's, and a licence
stands wherever one of its notices is there but for at most ``max_missing`` of
its words, and no other licence's notice explains the same words better. What
differs is reported, at the line of the first word.

Null and empty texts have no blocks. Repeated rows are scanned alike and give
one row per doc_id and licence. Ties go to the licence first by name. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, with_defaults

#: Notices of common licences, as their stewards word them.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "This project is licensed under the BSD 2-Clause License"),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "This project is licensed under the BSD 3-Clause License"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-3.0": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "proprietary": ("All rights reserved",),
}
#: Words of which every notice above has one.
KEYWORDS = r"(?i)licen[sc]e|copyright|\brights\W+reserved|redistribution|public\W+domain|permission|\bCC0\b|\bCC\W+BY"
#: Words on each side of a keyword (the longest notice with all its differences has fewer), and of a window.
AROUND, WINDOW, STEP = 40, 160, 80
WORD = regex.compile(r"[\w.+-]*\w")
#: As they stand in texts: a word may go on, after a hyphen, behind the line end and comment marks.
BREAK = regex.compile(r"-[ \t\r]*\n[\s*#/;]*")
BROKEN = regex.compile(r"[\w.+-]*\w(?:-[ \t\r]*\n[\s*#/;]*[\w.+-]*\w)?")
MAX_MISSING = 0.12


def blocks(text: str) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """(index of the first word, words with their places in the text) of the candidate blocks."""
    keys = [m.start() for m in keyword().finditer(text)]
    if not keys:
        return
    words = [(BREAK.sub("-", m.group().lower()), m.start()) for m in BROKEN.finditer(text)]
    places = [at for _, at in words]
    spans: list[list[int]] = []
    for k in keys:
        i = bisect_right(places, k)
        low, high = max(0, i - AROUND), min(len(words), i + AROUND)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for low, high in spans:
        for at in range(low, max(low + 1, high - STEP), STEP):
            yield at, words[at : min(at + WINDOW, high)]


@lru_cache(maxsize=1)
def keyword():
    return regex.compile(KEYWORDS)


@lru_cache(maxsize=1)
def compressors():
    import zstandard as z

    held = {}
    for name, notices in NOTICES.items():
        d = z.ZstdCompressionDict("\n".join(notices).lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        held[name] = z.ZstdCompressor(level=19, dict_data=d, write_content_size=False)
    return z.ZstdCompressor(level=19, write_content_size=False), held


def reductions(block: str) -> dict[str, float]:
    """The share of the block's compressed size that each licence's notices save."""
    plain, held = compressors()
    data = block.encode()
    size = len(plain.compress(data))
    return {name: 1 - len(c.compress(data)) / size for name, c in held.items()}


def candidates(words: list[str], max_missing: float = MAX_MISSING) -> dict[str, float]:
    """The block's reductions by the licences that shorten it or a piece of it, largest first."""
    plain, held = compressors()
    saved, sizes = reductions(" ".join(words)), {}

    def shortened(name: str, longest: int) -> bool:
        for at in range(0, max(1, len(words) - longest), longest):  # what is no longer lies within one piece
            data = " ".join(words[at : at + 2 * longest]).encode()
            if data not in sizes:
                sizes[data] = len(plain.compress(data))
            if len(held[name].compress(data)) < sizes[data]:
                return True
        return False

    spans: dict[str, set[int]] = {}
    for name, a in worded():
        spans.setdefault(name, set()).add(len(a) + int(max_missing * len(a)))
    good = [name for name, r in saved.items() if r > 0 or any(shortened(name, n) for n in spans[name])]
    return {name: saved[name] for name in sorted(good, key=lambda name: (-saved[name], name))}


@lru_cache(maxsize=1)
def worded() -> list[tuple[str, list[str]]]:
    return [(name, [w.lower() for w in WORD.findall(notice)]) for name, notices in NOTICES.items() for notice in notices]


def places_of(a: list[str], b: list[str], max_missing: float) -> Iterator[tuple[list[str], list[str], tuple[int, int]]]:
    """(words missing, words put in between, span in words) wherever the notice ``a`` is within the block ``b``."""
    slack, held = int(max_missing * len(a)), set(b)
    if sum(w in held for w in a) < len(a) - slack:
        return
    b = list(b)
    while True:
        run = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        if run.size * (2 * slack + 1) < len(a) - slack or not run.size:  # a notice has no more runs than differences and one
            return
        low = max(0, run.b - run.a - slack)
        high = run.b + len(a) - run.a + slack
        found = [m for m in SequenceMatcher(None, a, b[low:high], autojunk=False).get_matching_blocks() if m.size]
        hit = {m.a + i for m in found for i in range(m.size)}
        inside = {low + m.b + i for m in found for i in range(m.size)}
        span = (min(inside), max(inside) + 1)
        missing, extra = [w for i, w in enumerate(a) if i not in hit], [b[i] for i in range(*span) if i not in inside]
        good = len(missing) <= slack and len(extra) <= slack
        if good:
            yield missing, extra, span
        for i in range(*span) if good else range(run.b, run.b + run.size):
            b[i] = ""


def confirmed(text: str, max_missing: float = MAX_MISSING) -> list[dict]:
    """The licences whose notice is in the text, with line, reduction and wording differences."""
    good = []
    for at, block in blocks(text):
        b = [w for w, _ in block]
        for name, saved in candidates(b, max_missing).items():
            for a in (a for other, a in worded() if other == name):
                for missing, extra, (low, high) in places_of(a, b, max_missing):
                    line = text.count("\n", 0, block[low][1])
                    good.append({"license": name, "line": line, "reduction": saved, "common": len(a) - len(missing), "missing": missing, "extra": extra, "span": (at + low, at + high)})
    good.sort(key=lambda g: (len(g["missing"]) + len(g["extra"]), -g["common"], -g["reduction"], g["license"]))
    out: list[dict] = []
    for g in good:  # of notices over the same words, the one with the fewest differences
        if all(g["span"][1] <= o["span"][0] or g["span"][0] >= o["span"][1] for o in out):
            out.append(g)
    return out


def scan(docs: DataFrame, max_missing: float = MAX_MISSING) -> DataFrame:
    """A row for each place of a licence: doc_id, line, license, reduction, missing, extra."""
    small_batches(docs.sparkSession)
    docs = with_defaults(docs, doc_id="bigint", text="string").where(F.col("text").rlike(KEYWORDS))
    names = ["doc_id", "line", "license", "reduction", "missing", "extra"]

    def run(batches):
        for batch in batches:
            out = [
                (doc, g["line"], g["license"], g["reduction"], g["missing"], g["extra"])
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for g in confirmed(text, max_missing)
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return docs.mapInArrow(run, "doc_id bigint, line bigint, license string, reduction double, missing array<string>, extra array<string>")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "license").agg(
        F.min("line").alias("first_line"), F.countDistinct("line").alias("n_lines"),
        F.round(F.max("reduction"), 6).alias("reduction"), F.min(F.size("missing") + F.size("extra")).alias("word_differences"),
    )
