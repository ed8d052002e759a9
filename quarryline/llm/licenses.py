"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut to words; of each window of `window` neighbouring word n-grams the
one of least hash goes to an inverted index. All n-grams of a document are looked up
there, so a run of n + window - 1 words or more that it shares with a template is
found. A template too short to keep such a run when all the words that `coverage`
allows are missing or other words has all of its n-grams indexed, or all shorter ones.
Hits of a template on neighbouring diagonals are one candidate, and a local
alignment within a band around them counts the template's words that the document
has and where they lie.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: (license, words of its notice or of a paragraph of its text); fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORD = re.compile(rb"[a-z0-9]+")
_SPAN = re.compile(r"[A-Za-z0-9]+")
CACHE = 20_000


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes: only A to Z become lower case


def align(a: list[int], b: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Local alignment of a with b where b's position less a's is from low to high.

    A match counts 1, a mismatch or gap -1. Returns the words of a matched on the best
    path and the stretch of b that it covers; of equal paths that with more matches
    counts, then the earlier end in a, then in b.
    """
    width, n = high - low + 1, len(b)
    zero = (0, 0, -1, -1)  # score, matches, first and past in b
    above, best = [zero] * width, zero
    for i, x in enumerate(a):
        row = []
        for k in range(width):
            j = i + low + k
            if not 0 <= j < n:
                row.append(zero)
                continue
            s, m, f, _ = above[k]
            if x == b[j]:
                cell = (s + 1, m + 1, f if m else j, j + 1)
            else:
                cell = (s - 1, m, f, j)
            up = above[k + 1] if k + 1 < width else zero
            left = row[k - 1] if k else zero
            for other in (up, left):
                if (other[0] - 1, other[1]) > cell[:2]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] <= 0:
                cell = zero
            row.append(cell)
            if cell[:2] > best[:2]:
                best = cell
        above = row
    return best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates=TEMPLATES, n: int = 3, window: int = 2, coverage: float = 0.8):
        self.names = [name for name, _ in templates]
        spelled = [words_of(t) for _, t in templates]
        if any(len(t) < n + window - 1 for t in spelled):
            raise ValueError(f"a template needs {n + window - 1} words or more")
        self.ids = {w: i for i, w in enumerate(sorted({w for t in spelled for w in t}))}
        self.words = [[self.ids[w] for w in t] for t in spelled]
        self.n, self.coverage, self.cache = n, coverage, {}
        index: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.words):
            run = self.sure_run(len(ids))
            if run < n:
                for k, g in enumerate(self.grams(np.array(ids, np.int64), run).tolist()):
                    short.setdefault(run, {}).setdefault(g, []).append((t, k))
            grams = self.grams(np.array(ids, np.int64))
            rank = [(g * 0x9E3779B97F4A7C15) % (1 << 64) for g in grams.tolist()]
            chosen = set()
            if n <= run < n + window - 1:
                chosen.update(range(len(grams)))
            for i in range(len(grams) - window + 1):
                chosen.add(min(range(i, i + window), key=lambda k: (rank[k], -k)))
            for k in sorted(chosen):
                index.setdefault(int(grams[k]), []).append((t, k))
        self.keys = np.array(sorted(index), np.int64)
        self.posts = [index[k] for k in self.keys.tolist()]
        self.indexes = [(n, self.keys, self.posts), *((m, np.array(sorted(x), np.int64), [x[k] for k in sorted(x)]) for m, x in sorted(short.items()))]

    def sure_run(self, words: int) -> int:
        """The words in a row that stay where as many of a template's words as coverage allows are missing or other words."""
        keep = next(k for k in range(words + 1) if k >= self.coverage * words)
        return -(-keep // (words - keep + 1))

    def grams(self, ids: np.ndarray, n: int | None = None) -> np.ndarray:
        """A number for each n-gram; -1 where a word is in no template."""
        n = n or self.n
        m = len(ids) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(n):
            part = ids[k : k + m]
            out, known = out * len(self.ids) + part, known & (part >= 0)
        return np.where(known, out, -1)

    def scan(self, text: str | None) -> list[dict]:
        """Matches in order: license, template (its number), matched_words, template_words, coverage, start and end (code points)."""
        if not text:
            return []
        get = self.ids.get
        found = words_of(text)
        ids = np.array([get(w, -1) for w in found], np.int64)
        diagonals: dict[int, list[int]] = {}
        for n, keys, posts in self.indexes:
            grams = self.grams(ids, n)
            at = np.nonzero(grams >= 0)[0]
            k = np.searchsorted(keys, grams[at])
            k[k == len(keys)] = 0
            hit = keys[k] == grams[at]
            for p, q in zip(at[hit].tolist(), k[hit].tolist(), strict=True):
                for t, place in posts[q]:
                    diagonals.setdefault(t, []).append(p - place)
        matches = []
        for t, ds in diagonals.items():
            ds = sorted(set(ds))
            size, band = len(self.words[t]), max(2, len(self.words[t]) // 8)
            a = 0
            for i in range(1, len(ds) + 1):
                if i == len(ds) or ds[i] - ds[i - 1] > band or ds[i] - ds[a] > 4 * band:
                    matches.append(self._match(t, ids, ds[a], ds[i - 1], band, size))
                    a = i
        matches = [m for m in matches if m[1] >= self.coverage * len(self.words[m[0]])]
        matches.sort(key=lambda m: (-m[1], -m[1] / len(self.words[m[0]]), m[0], m[2]))
        taken, kept = [], []
        for m in matches:
            if all(m[3] <= a or m[2] >= b for a, b in taken):
                taken.append((m[2], m[3]))
                kept.append(m)
        if not kept:
            return []
        spans = [x.span() for x in _SPAN.finditer(text)]
        return [
            {"license": self.names[t], "template": t, "matched_words": n, "template_words": len(self.words[t]), "coverage": n / len(self.words[t]), "start": spans[a][0], "end": spans[b - 1][1]}
            for t, n, a, b in sorted(kept, key=lambda m: m[2])
        ]

    def _match(self, t: int, ids: np.ndarray, low: int, high: int, band: int, size: int) -> tuple[int, int, int, int]:
        if low == high and low >= 0 and ids[low : low + size].tolist() == self.words[t]:
            return t, size, low, low + size
        first = max(0, low - band)
        part = ids[first : max(first, high + size + band)].tolist()
        key = (t, low - first, high - low, tuple(part))
        if key not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[key] = align(self.words[t], part, low - band - first, high + band - first)
        n, a, b = self.cache[key]
        return t, n, first + a, first + b


def scan(docs: DataFrame, scanner: Scanner | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, n_licenses and licenses, the matches in order of place.

    A template matches where at least `coverage` of its words align (0.8). Of matches
    that overlap, the one with more words stays, then the one of larger coverage, then
    the earlier template. Null, empty and wordless texts have none. Rows, repeated ones
    too, come back one each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    item = pa.struct([("license", pa.string()), ("template", pa.int32()), ("matched_words", pa.int32()), ("template_words", pa.int32()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in slices(batches, 0):
            found = [sent.value.scan(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(item))], names=[*keep, "n_licenses", "licenses"])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    return docs.select(F.col(text_col).alias("text "), *[F.col(k) for k in keep]).mapInArrow(
        run, ", ".join([*kinds, "n_licenses long", "licenses array<struct<license:string,template:int,matched_words:int,template_words:int,coverage:double,start:long,end:long>>"])
    )
