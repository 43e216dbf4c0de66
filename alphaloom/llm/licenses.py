"""License scan: winnowed fingerprints pick candidates, banded alignment reports spans.

Every template is cut into word 3-grams and winnowed: of each four neighbouring hashes the
least stays (short templates keep all). The fingerprints form an inverted index (hash -> template, place), a few
thousand numbers that travel with the tasks; `MAX_TEMPLATE_WORDS` bounds it. A text's
3-grams are looked up in it; hits of a template on neighbouring diagonals are one
candidate, and a local alignment in a band about them counts the template's matched words.
The band is aligned again with the words outside its matches, so that a notice that follows
itself within the band is found each time.

A match is reported from `min_coverage` on; of overlapping matches the one with most
matched words stays (ties: higher coverage, then template name, then place).

Defined results: words are compared without A-Z case and outer punctuation. NULL, empty
and blank texts have no matches. Repeated rows and repeated notices are reported each.
Only doc_id and the text are read, so other columns can't clash. Templates of fewer than
three words are refused. Empty tables give no rows.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alphaloom.llm.common import WORD
from alphaloom.llm.tokens import WordHashes, windows

K, WINDOW, BAND = 3, 4, 8
MAX_TEMPLATE_WORDS = 200_000

#: The licences' usual notices.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/license": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "BSD-3-Clause/license": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "MPL-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "ISC/license": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense/license": "This is free and unencumbered software released into the public domain.",
    "Proprietary/notice": "All rights reserved.",
}


def _normal(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]{}<>*#$%&|") or word


WORDS = WordHashes(_normal)


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray  # sorted fingerprints
    template: np.ndarray
    place: np.ndarray


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least hash (the rightmost of equals) of each window; a short template keeps all."""
    if len(hashes) < 4 * window:
        return list(range(len(hashes)))
    picks = {}
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        picks[i + window - 1 - int(np.argmin(part[::-1]))] = True
    return list(picks)


def index(templates: dict[str, str]) -> Index:
    words, keys, which, place = [], [], [], []
    for n, text in enumerate(templates.values()):
        flat, starts = WORDS.flat([text])
        if len(flat) < K:
            raise ValueError("a template needs three words at least")
        grams, _ = windows(flat, starts, K)
        for p in winnow(grams):
            keys.append(grams[p])
            which.append(n)
            place.append(p)
        words.append(flat)
    if sum(map(len, words)) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to send to every task")
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    return Index(
        list(templates), words, np.array(keys, np.uint64)[order], np.array(which, np.int64)[order],
        np.array(place, np.int64)[order],
    )


def align(text: np.ndarray, template: np.ndarray, low: int, high: int, begin: int, stop: int) -> tuple[int, int, int]:
    """Best local alignment of the template with the words begin..stop of a text, on the
    diagonals low..high: (matched words, first word, end). Match 2, other word -1, gap -1;
    ties go to the earlier end."""
    width = high - low + 1
    zero = (0, 0, 0)  # score, matches, first word of the alignment
    before = [zero] * (width + 1)
    best, found = 0, (0, 0, 0)
    for q, word in enumerate(template.tolist()):
        row, left = [zero] * (width + 1), zero
        for j in range(width):
            p = q + low + j
            if p < begin or p >= stop:
                left = zero
                continue
            score, matched, first = before[j]  # diagonal: (p - 1, q - 1)
            if int(text[p]) == word:
                cell = (score + 2, matched + 1, first if score > 0 else p)
            else:
                cell = (score - 1, matched, first)
            up = before[j + 1]  # (p, q - 1)
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = zero
            row[j] = left = cell
            if cell[0] > best:
                best, found = cell[0], (cell[1], cell[2], p + 1)
        before = row
    return found


def occurrences(text: np.ndarray, template: np.ndarray, diagonals: list[int], min_coverage: float) -> list[tuple[int, int, int]]:
    """(matched, first word, end) of one template's matches in the bands about the diagonals.
    Of overlapping ones the one with most matched words stays; the bands are then aligned
    again with the words left between the matches, until none gives a further match."""
    size, found, bands = len(template), [], diagonals
    while bands:
        new, live = [], []
        for d in bands:
            at, stop = max(d - BAND, 0), min(d + 2 * BAND + size, len(text))
            gaps = []
            for _, first, end in found[bisect_right(found, at, key=lambda m: m[2]) :]:
                if first >= stop:
                    break
                gaps.append((at, first))
                at = end
            gaps.append((at, stop))
            hits = [align(text, template, d - BAND, d + 2 * BAND, a, b) for a, b in gaps if b - a >= min_coverage * size]
            hits = [m for m in hits if m[0] and m[0] >= min_coverage * size]
            if hits:
                live.append(d)
                new += hits
        spans: list[tuple[int, int, int]] = []
        for m in sorted(set(new), key=lambda m: (-m[0], m[1])):
            k = bisect_left(spans, m[1], key=lambda o: o[1])
            if (k == 0 or spans[k - 1][2] <= m[1]) and (k == len(spans) or m[2] <= spans[k][1]):
                spans.insert(k, m)
        found, bands = sorted(found + spans, key=lambda m: m[1]), live
    return found


def matches(text: np.ndarray, grams: np.ndarray, ix: Index, min_coverage: float) -> list[tuple]:
    """(template, matched, first word, end) of one text's reported matches, by place."""
    at = np.searchsorted(ix.keys, grams)
    at[at == len(ix.keys)] = 0
    hits = np.flatnonzero(ix.keys[at] == grams)
    seeds = []
    for p in hits.tolist():
        k = int(at[p])
        while k < len(ix.keys) and ix.keys[k] == grams[p]:
            seeds.append((int(ix.template[k]), p - int(ix.place[k])))
            k += 1
    bands: dict[int, list[int]] = {}
    for n, diagonal in sorted(set(seeds)):
        of = bands.setdefault(n, [])
        if not of or diagonal - of[-1] > BAND:  # else within the band of the candidate before
            of.append(diagonal)
    found = [(n, *m) for n, of in bands.items() for m in occurrences(text, ix.words[n], of, min_coverage)]
    found.sort(key=lambda m: (-m[1], -m[1] / len(ix.words[m[0]]), ix.names[m[0]], m[2]))
    out: list[tuple] = []
    for m in found:
        if all(m[3] <= o[2] or m[2] >= o[3] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: m[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, text: str = "text", min_coverage: float = 0.8) -> DataFrame:
    """(doc_id, template, license, matched_words, template_words, coverage, start, end); code points."""
    ix = index(TEMPLATES if templates is None else templates)
    schema = T.StructType([docs.schema["doc_id"]] + [
        T.StructField("template", T.StringType()), T.StructField("license", T.StringType()),
        T.StructField("matched_words", T.LongType()), T.StructField("template_words", T.LongType()),
        T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    known = np.unique(ix.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(text).to_pylist()
                flat, starts = WORDS.flat(texts)
                grams, owner = windows(flat, starts, K)
                near = np.searchsorted(known, grams)
                near[near == len(known)] = 0
                rows, cells = [], []
                for r in np.unique(owner[known[near] == grams]).tolist() if len(known) else []:
                    own = flat[starts[r] : starts[r + 1]]
                    first, end = np.searchsorted(owner, (r, r + 1))
                    found = matches(own, grams[first:end], ix, min_coverage)
                    if found:
                        places = [m.span() for m in word.finditer(texts[r])]
                        for n, matched, a, b in found:
                            size = len(ix.words[n])
                            rows.append(r)
                            cells.append((ix.names[n], ix.names[n].split("/")[0], matched, size, matched / size,
                                          places[a][0], places[b - 1][1]))
                ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([c[k] for c in cells], t) for k, t in enumerate(
                        (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())))],
                    names=schema.names,
                )

    return docs.select("doc_id", text).mapInArrow(run, schema)
