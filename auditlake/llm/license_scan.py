"""Licence scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of letters, digits and characters beyond ASCII, lower-cased.
Templates and texts become shingles of five words. A template of fewer words is one shingle
of that many words, as are the texts that it is looked for in. A template of m shingles
belongs to the class of the next block length b >= m; a document's windows of a
class are 2 b shingles long and begin every b, so that each stretch of m shingles
lies whole within a window.

A window that holds CONTAIN of a template has a Jaccard similarity to it of at
least CONTAIN * m / (2 b + (1 - CONTAIN) * m). With BANDS bands of one row a window
and a template collide in some band with probability 1 - (1 - J) ** BANDS; class
lengths are dense enough that this is over 0.999 (guaranteed() gives it for every
template). Minima of windows are those of two neighbouring blocks, so all classes
share one pass of hashing.

Candidates are verified: distinct shingles of the template in the window, over
all of the template's, must reach CONTAIN. Overlapping windows of one template are
one match, and a match that lies within a longer template's match is left out.

Null and empty texts have no match. Repeated rows give a row each; other columns
are not read. Without templates nothing matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import U64, hash_shingles, hash_words, table, text_bytes, text_chunks

CONTAIN = 0.75
BANDS = 32
#: Block lengths, in shingles; block_of() goes on behind the last.
BLOCKS = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024, 2048)
_r = np.random.default_rng(4)
_MULTIPLY = (_r.integers(1, 2**63, BANDS, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_ADD = _r.integers(0, 2**63, BANDS, dtype=np.int64).astype(U64)
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

# Customary notices and permission texts of common licences.
TEMPLATES = {
    "apache-2.0:line": "Licensed under the Apache License, Version 2.0",
    "mit:line": "Released under the MIT License",
    "gpl-3.0:line": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0:line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0:line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0:line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mpl-2.0:notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit:permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc:permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd:permission": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0:notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0:notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-3.0:line": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "agpl-3.0:line": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "epl-2.0:notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0:line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "bsl-1.0:line": "Distributed under the Boost Software License, Version 1.0",
    "zlib:permission": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mit:warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd:warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "unlicense:notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


SIZE = 5


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(*text_bytes(column), _INSIDE)


def _hashed(shingles: np.ndarray, band: int) -> np.ndarray:
    x = shingles * _MULTIPLY[band]
    x += _ADD[band]
    x ^= x >> U64(29)
    x *= U64(0x9E3779B97F4A7C15)
    return x


def block_of(m: int) -> int:
    """The least block length for a template of m shingles; behind BLOCKS they go on as 3 and 4 times
    powers of two, which keeps guaranteed() over 0.999."""
    k = BLOCKS[-1]
    while k < m and k + k // 2 < m:
        k *= 2
    return next(b for b in (*BLOCKS, k, k + k // 2) if b >= m)


def guaranteed(m: int) -> float:
    """Least probability that a window which holds CONTAIN of a template of m shingles retrieves it."""
    block = block_of(m)
    need = -(-m * 3 // 4) if CONTAIN == 0.75 else int(np.ceil(CONTAIN * m))
    return 1 - (1 - need / (2 * block + m - need)) ** BANDS


class Templates:
    """Signatures of templates by class. All have SIZE words or more, or all have ``size`` words."""

    def __init__(self, texts: dict[str, str], size: int = SIZE):
        self.size = size
        words, at = _words(pa.array([texts[n] for n in sorted(texts)], pa.string()))
        counts = dict(zip(sorted(texts), np.diff(at).tolist()))
        fits = (lambda n: n >= SIZE) if size == SIZE else (lambda n: n == size)
        self.names = [n for n in sorted(texts) if fits(counts[n])]
        s, at = hash_shingles(*_words(pa.array([texts[n] for n in self.names], pa.string())), size)
        self.sets = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]
        # those of fewer words are looked for by shingles of their own size
        self.shorter = [Templates(texts, n) for n in sorted({n for n in counts.values() if 0 < n < SIZE})] if size == SIZE else []
        self.classes: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            self.classes.setdefault(block_of(len(own)), []).append(k)
        self.minima = np.array([[_hashed(own, b).min() for b in range(BANDS)] for own in self.sets], U64).reshape(-1, BANDS)

    def candidates(self, s: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By template, the (text, from, to) windows of shingles that share a band with it."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        if not len(s):
            return {}
        layout = {}
        counts = np.diff(at)
        for block in self.classes:
            blocks = -(-counts // block)
            owner = np.repeat(np.arange(len(counts)), blocks)
            first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
            starts = at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * block
            # a window joins a block and the next of the same text, if there is one
            follows = np.zeros(len(owner), bool)
            follows[:-1] = owner[1:] == owner[:-1]
            layout[block] = owner, starts, follows
        for band in range(BANDS):
            h = _hashed(s, band)
            for block, templates in self.classes.items():
                owner, starts, follows = layout[block]
                low = np.minimum.reduceat(h, starts)
                window = low.copy()
                window[:-1] = np.where(follows[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                wanted = self.minima[templates, band]
                maybe = np.zeros(1 << 16, bool)
                maybe[(wanted >> U64(48)).astype(np.int64)] = True
                for w in np.flatnonzero(maybe[(window >> U64(48)).astype(np.int64)]):
                    for k in templates:
                        if self.minima[k, band] == window[w]:
                            text = int(owner[w])
                            found.setdefault(k, set()).add((text, int(starts[w]), int(min(starts[w] + 2 * block, at[text + 1]))))
        return {k: sorted(v) for k, v in found.items()}

    def _verified(self, words: np.ndarray, word_at: np.ndarray, out: list[list[tuple[str, int, int, float]]]) -> None:
        """Adds to each text's list its windows that hold enough of a template; those of one template that overlap are one."""
        s, at = hash_shingles(words, word_at, self.size)
        n_words = np.diff(word_at)
        for k, windows in self.candidates(s, at).items():
            own, last = self.sets[k], (-1, -1)
            for text, a, b in windows:
                hit = np.flatnonzero(np.isin(s[a:b], own))
                share = len(np.unique(s[a:b][hit])) / len(own)
                if share < CONTAIN:
                    continue
                # each occurrence of a single shingle is a match of its own
                runs = [(h, h) for h in hit.tolist()] if len(own) == 1 else [(int(hit[0]), int(hit[-1]))]
                for first, final in runs:
                    start, end = a + first - int(at[text]), min(a + final - int(at[text]) + self.size, int(n_words[text]))
                    if last[0] == text and start < last[1]:
                        before = out[text][-1]
                        out[text][-1] = (before[0], min(before[1], start), max(before[2], end), max(before[3], share))
                        last = (text, max(last[1], end))
                    else:
                        out[text].append((self.names[k], start, end, share))
                        last = (text, end)

    def matches(self, column: pa.Array) -> tuple[list[list[tuple[str, int, int, float]]], np.ndarray]:
        """Verified (name, first word, end word, containment) of each text, and its number of words."""
        words, word_at = _words(column)
        n_words = np.diff(word_at)
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in n_words]
        for part in (self, *self.shorter):
            part._verified(words, word_at, out)
        return [outermost(m) for m in out], n_words


def outermost(matches: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The matches that lie in no other, by start, then name; of those of one place the last by name. Those of one name don't
    overlap, so in order of start, longest first, a match lies in an earlier one if it ends before the furthest end so far."""
    out, furthest = [], -1
    for x in sorted(sorted(matches, key=lambda x: x[0], reverse=True), key=lambda x: (x[1], -x[2])):
        if x[2] > furthest:
            out.append(x)
            furthest = x[2]
    return sorted(out, key=lambda x: (x[1], x[0]))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_matches, licenses, matches) of each row; positions in words."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = TEMPLATES if templates is None else templates
    fields = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches):
        known = Templates(texts)
        for batch in batches:
            for part in text_chunks(batch):
                found, n_words = known.matches(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([len(m) for m in found], pa.int64()),
                        pa.array([",".join(sorted({x[0].split(":")[0] for x in m})) for m in found], pa.string()),
                        pa.array([[dict(zip(("template", "start", "end", "containment"), x)) for x in m] for m in found], fields),
                    ],
                    ["doc_id", "n_words", "n_matches", "licenses", "matches"],
                )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_matches long, licenses string, matches array<struct<template:string,start:long,end:long,containment:double>>"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))
