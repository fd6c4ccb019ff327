"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

Every template's word k-grams are hashed and winnowed: of each run of neighbouring hashes the smallest is kept, so any run of
GRAM + WINNOW - 1 words that a document shares with a template contains a kept one. The inverted index maps kept hashes to template and
position. A document's k-grams that hit the index give diagonals; neighbouring diagonals of one template form a candidate, and a local
alignment in a band around them reports how many of the template's words are matched, and where.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import in_slices, small_batches, table

GRAM, WINNOW = 3, 2
#: Report a template where so large a share of its words is matched; the second holds for templates of fewer than SHORT words.
COVERAGE, COVERAGE_SHORT, SHORT = 0.75, 0.9, 20
#: A part of a template is reported with its coverage where it has so many matched words.
PARTIAL = 30
MATCH, MISMATCH, GAP = 2, -1, -1
#: Entries of a worker's memory of words; longer words aren't remembered.
MEMORY, LONGEST = 200_000, 64

#: License notices.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0 (notice)": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 (sentence)": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0 (sentence)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE"
        " FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,"
        " ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to"
        " use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be"
        " misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
        " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
        " binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the"
        " software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment"
        " in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT"
        " OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display,"
        " distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The"
        " copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in"
        " part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS"
        " PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT"
        " SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR"
        " THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0 (header)": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0 (header)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR"
        " PURPOSE. See the GNU General Public License for more details."
    ),
}
#: The parts of BSD licenses, sentences that name a license, and identifiers that stand in one-line tags.
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
    " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED"
    " TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING"
    " NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
PHRASES = {
    "MIT": "the MIT License", "Apache-2.0": "the Apache License, Version 2.0", "GPL-3.0": "the GNU General Public License, version 3", "GPL-2.0": "the GNU General Public License, version 2", "ISC": "the ISC License",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1", "LGPL-3.0": "the GNU Lesser General Public License, version 3", "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "MPL-2.0": "the Mozilla Public License, version 2.0", "BSD-3-Clause": "the BSD 3-Clause License", "BSD-2-Clause": "the BSD 2-Clause License", "EPL-2.0": "the Eclipse Public License 2.0", "BSL-1.0": "the Boost Software License, Version 1.0",
    "CC0-1.0": "CC0 1.0 Universal", "CC-BY-SA-4.0": "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-4.0": "a Creative Commons Attribution 4.0 International License",
}
TAGS = (
    "MIT ISC Zlib Unlicense Apache-2.0 MPL-2.0 EPL-2.0 BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later"
    " LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"
).split()
TEMPLATES |= {"BSD-2-Clause": BSD_TERMS + BSD_DISCLAIMER, "BSD-3-Clause": BSD_TERMS + BSD_NAMES + BSD_DISCLAIMER}
TEMPLATES |= {f"{name} (header)": TEMPLATES["GPL-3.0 (header)"].replace("GNU General", f"GNU {kind} General").replace("version 3", f"version {v}") for name, kind, v in (("LGPL-3.0", "Lesser", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("AGPL-3.0", "Affero", "3"))}
TEMPLATES |= {"GPL-2.0 (header)": TEMPLATES["GPL-3.0 (header)"].replace("version 3", "version 2")}
TEMPLATES |= {f"{name} (phrase)": f"under {phrase}" for name, phrase in PHRASES.items()}
TEMPLATES |= {f"{name} (tag)": f"SPDX-License-Identifier: {name}" for name in TAGS}


RUNS = re.compile(r"[^\W_]+")


def plain(word: str) -> list[str]:
    """The runs of letters and digits in what white space delimits, in lower case: the words of templates and texts."""
    return RUNS.findall(word.lower())


class Scanner:
    """Index and aligner over templates; `vocabulary` numbers the templates' words from 1, all others are 0."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(p, len(self.vocabulary) + 1) for p in plain(templates[n])] for n in self.names]
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            grams = [self.hashed(*own[i : i + GRAM]) for i in range(len(own) - GRAM + 1)]
            kept = {min(range(i, min(i + WINNOW, len(grams))), key=lambda j: (grams[j], -j)) for i in range(max(1, len(grams) - WINNOW + 1))} if grams else set()
            for i in sorted(kept):
                index[grams[i]].append((t, i))
        self.index = dict(index)
        self.seen: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def hashed(*ids: int) -> int:
        return xxhash.xxh64_intdigest(np.array(ids, dtype="<u4").tobytes())

    def numbers(self, word: str) -> tuple[int, ...]:
        """The numbers of the words in what white space delimits, 0 where no template has one."""
        found = self.seen.get(word)
        if found is None:
            found = tuple(self.vocabulary.get(p, 0) for p in plain(word))
            if len(word) <= LONGEST:
                if len(self.seen) >= MEMORY:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
        """(template, matched words, template's words, coverage, start, end) of each place, in order of the text; start and end in characters."""
        found = list(map(self.numbers, (text or "").split()))
        at = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        own = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=len(at))
        if len(own) < GRAM:
            return []
        known = own > 0
        full = np.flatnonzero(np.logical_and.reduce([known[j : len(own) - GRAM + 1 + j] for j in range(GRAM)]))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in full.tolist():
            for t, p in self.index.get(self.hashed(*own[i : i + GRAM].tolist()), ()):
                hits[t].append((i - p, i))
        places = []
        for t, found in hits.items():
            band = max(4, len(self.words[t]) // 8)
            found.sort()
            group: list[tuple[int, int]] = []
            for x in [*found, None]:
                if x is None or group and x[0] - group[-1][0] > band:
                    places += self.align(t, own, group[0][0] - band, group[-1][0] + band)
                    group = []
                if x is not None:
                    group.append(x)
        places.sort(key=lambda p: (len(self.words[p[0]]) - 2 * p[1], p[3] - p[2], p[2], p[0]))
        taken: list[tuple] = []
        for t, n, a, b in places:
            if all(b < c or d < a for _, _, c, d in taken):
                taken.append((t, n, a, b))
        if not taken:
            return []
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        return [(self.names[t], n, len(self.words[t]), n / len(self.words[t]), spans[at[a]][0], spans[at[b]][1]) for t, n, a, b in sorted(taken, key=lambda p: p[2])]

    def align(self, t: int, own: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """The local alignments of template t on diagonals low to high that cover enough, best first, none on words of a better one: rows
        (template, matched, first word, last word)."""
        found, own = [], own.copy()
        while place := self.best(t, own, low, high):
            found.append(place)
            own[place[2] : place[3] + 1] = -1
        return found

    def best(self, t: int, own: np.ndarray, low: int, high: int) -> tuple[int, int, int, int] | None:
        """The best local alignment, if it covers enough."""
        template = self.words[t]
        width = high - low + 1
        score = [0] * (width + 2)
        above = [(0, -1)] * (width + 2)  # matched, first word of the way here
        best = (0, 0, -1, -1)
        ids = own.tolist()
        for i, word in enumerate(template):
            row, way = [0] * (width + 2), [(0, -1)] * (width + 2)
            for k in range(1, width + 1):
                d = i + low + k - 1
                if not 0 <= d < len(ids):
                    continue
                same = ids[d] == word
                options = [(score[k] + (MATCH if same else MISMATCH), above[k], same), (row[k - 1] + GAP, way[k - 1], False), (score[k + 1] + GAP, above[k + 1], False)]
                s, (n, first), hit = max(options, key=lambda x: x[0])
                if s > 0:
                    row[k], way[k] = s, (n + hit, d if first < 0 else first)
                    if hit and (s, n + 1) > best[:2]:
                        best = (s, n + 1, way[k][1], d)
            score, above = row, way
        enough = len(template) * (COVERAGE_SHORT if len(template) < SHORT else COVERAGE)
        return (t, *best[1:]) if best[1] >= min(enough, max(PARTIAL, SHORT)) and best[1] else None


FOUND = "doc_id long, license string, matched int, words int, coverage double, start_char long, end_char long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each place in docs(doc_id, text) where a template's words are matched: doc_id, license, matched and words (of the
    template), coverage, start_char, end_char. Of overlapping places the one with the most matched less unmatched words stays.

    Case and what is neither letter nor digit don't count. Null and empty texts have no places; rows may repeat and ids be null. An empty
    table or no template gives no rows; other columns aren't read. Templates of fewer than 3 words are never found.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in in_slices(batches):
            rows = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in own.scan(text)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_licenses of all documents for all templates: a row for each place."""
    return scan_licenses(table(spark, sf_dir, "documents"))
