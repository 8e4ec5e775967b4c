"""Operator 7, license scans: MinHash bands over text windows, then exact shingle containment.

Words are lower-case runs of letters and digits with inner dots and hyphens;
shingles have five words, or all words of a shorter template.  A template of m
shingles, M being the next power of two, is sought in windows of 2 M shingles
that overlap by M, so that any run of m shingles lies within one window.  A
window whose minimum under one of the template's hash functions is the
template's retrieves it (bands of one row).  With ceil(0.8 m) shingles of the
template present, the Jaccard similarity to that window is at least
j = ceil(0.8 m) / (2 M + m - ceil(0.8 m)); a template has as many bands as make
the probability of a miss, (1 - j) to the number of bands, ``MISS`` at most.
Every template goes this way, from two words to a whole license.

A retrieved pair of document and template is verified on the whole text:
places of the template's shingles that are at most m apart form a cluster, and
a cluster with at least ``CONTAINED`` of the distinct shingles is a match.

Null and empty texts have no match; documents without a match have no row; an
empty table has no rows; repeated rows repeat their matches; other columns are
dropped, whatever their names.  Matches of several templates at one place are
all reported.  Whole texts are scanned, in steps of bounded size; a longer text
is a step of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import mapper, texts

WIDTH = 5
CONTAINED = 0.8
#: Greatest probability with which a match at the threshold isn't retrieved.
MISS = 5e-5
SEED = 20_240_501

# Public license notices, by license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
)

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.\-][a-z0-9\x80-\xff]+)*")
_M = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` word hashes."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = _mix(out + words[k : k + n] * _M[0] + np.uint64(k + 1))
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + _M[0])


def bands_for(shingles: int) -> int:
    """Bands that retrieve a template of so many shingles at the threshold but for ``MISS``."""
    window, present = 2 << (shingles - 1).bit_length(), math.ceil(CONTAINED * shingles)
    alike = present / (window + shingles - present)
    return math.ceil(math.log(MISS) / math.log1p(-alike))


class Scanner:
    """Templates with their signatures."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        rng = np.random.default_rng(SEED)
        self.words = [words_of(t) for _, t in templates]
        self.widths = [min(WIDTH, len(w)) for w in self.words]
        self.hashes = [shingle_hashes(word_hashes(w), k) for w, k in zip(self.words, self.widths)]
        self.bands = [bands_for(len(np.unique(h))) for h in self.hashes]
        self.factors = rng.integers(1, 2**63, max(self.bands, default=0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.members: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # by width, then M
        for t, h in enumerate(self.hashes):
            self.members[self.widths[t]][1 << (len(h) - 1).bit_length()].append(t)

    def candidates(self, words: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(document, template) pairs of concatenated documents; ``owner`` has each word's document."""
        found: set[tuple[int, int]] = set()
        for width, by_scale in self.members.items():
            hashes = shingle_hashes(words, width)
            for band, factor in enumerate(self.factors if len(hashes) else ()):
                low, scale = None, 0
                for m in sorted(by_scale):
                    live = [t for t in by_scale[m] if self.bands[t] > band]
                    if not live:
                        continue
                    if low is None:
                        low, scale = self._blocks(hashes * factor, m), m
                    while scale < m:
                        low, scale = self._blocks(low, 2), scale * 2
                    window = low.copy()
                    np.minimum(window[:-1], low[1:], out=window[:-1])
                    for t in live:
                        for k in np.flatnonzero(window == (self.hashes[t] * factor).min()).tolist():
                            a, b = k * m, min(len(owner), (k + 2) * m + width)
                            found.update((d, t) for d in np.unique(owner[a:b]).tolist())
        return found

    @staticmethod
    def _blocks(values: np.ndarray, size: int) -> np.ndarray:
        """Minima of runs of ``size`` values; the last run may be short."""
        whole = len(values) // size * size
        least = values[:whole].reshape(-1, size).min(axis=1) if size > 1 else values[:whole]
        return np.r_[least, values[whole:].min(keepdims=True)] if whole < len(values) else least

    def verify(self, words: list[bytes], t: int) -> list[tuple[int, int, float]]:
        """First word, number of words and containment of each match of a template."""
        width, own = self.widths[t], self.words[t]
        shingles = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
        gap = len(own) - width + 1
        clusters: list[list[int]] = []
        for i in range(len(words) - width + 1):
            if tuple(words[i : i + width]) in shingles:
                if clusters and i - clusters[-1][-1] <= gap:
                    clusters[-1].append(i)
                else:
                    clusters.append([i])
        out = []
        for places in clusters:
            share = len({tuple(words[i : i + width]) for i in places}) / len(shingles)
            if share >= CONTAINED:
                out.append((places[0], places[-1] + width - places[0], share))
        return out


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


SCHEMA = "doc_id long, license string, template int, first_word long, n_words long, containment double"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each match: the license, its template's number, the place in words, the containment."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [words_of(t) for t in texts(batch, "text")]
        sizes = [len(x) for x in lists]
        owner = np.repeat(np.arange(len(lists)), sizes)
        s = scanner(templates)
        hashes = word_hashes([w for x in lists for w in x])
        rows = []
        for d, t in sorted(s.candidates(hashes, owner)):
            rows += [(d, templates[t][0], t, *m) for m in s.verify(lists[d], t)]
        d, license_, t, first, n, share = zip(*rows) if rows else [()] * 6
        columns = [
            batch.column(0).take(pa.array(d, pa.int64())),
            pa.array(license_, pa.string()),
            pa.array(t, pa.int32()),
            pa.array(first, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(share, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "template", "first_word", "n_words", "containment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mapper(step, "text"), SCHEMA)
