"""License scans by patience alignment (operator 9).

A text is held against license texts and notices, word by word.  Where a template's rarest words
stand in the text, the region around them is aligned with the template: words that are unique in
both, in the longest increasing subsequence of their places, are anchors; the gaps between
anchors are aligned in the same way, and equal words next to an anchor join it.  Where that covers too little though the words
are there (copies side by side, a template that repeats its words), a longest common subsequence around the seed is the last resort.  The share of
the template's words that are aligned is its coverage; from ``coverage`` on it is reported, with the
span of characters.  A name, year or holder put into the template only costs its own words.

Of overlapping finds the one with more aligned words stays.  Whole texts are scanned, each by
itself; there is no shuffle.  Null and empty texts have no finds, an empty table has none; repeated rows are scanned each;
other columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Short notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Public license texts.
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


#: The third condition of BSD-3-Clause, which is otherwise BSD-2-Clause.
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", THIRD + "THIS SOFTWARE IS PROVIDED")


def templates() -> list[tuple[str, list[str]]]:
    """(license, words) of every notice and text."""
    every = [(name, t) for name, ts in NOTICES.items() for t in ts] + list(TEXTS.items())
    return [(name, WORD.findall(t.lower())) for name, t in every]


def increasing(places: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        tops[k : k + 1] = [p]
        last[k : k + 1] = [i]
        before[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    rows = [[0] * (len(b) + 1)]
    for w in a:
        above, row = rows[-1], [0]
        for j, v in enumerate(b):
            row.append(above[j] + 1 if v == w else max(above[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), False, False)]
    while todo:
        a0, a1, b0, b1, after, ahead = todo.pop()
        while after and a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # what joins the anchor before
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while ahead and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:  # and the anchor behind
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        i, j = a0, b0
        for k, (p, q) in enumerate([*anchors, (a1, b1)]):
            if p > i and q > j:
                todo.append((i, p, j, q, k > 0 or after, k < len(anchors) or ahead))
            i, j = p + 1, q + 1
        out += anchors
    return sorted(set(out))


def may_miss(words: list[str], coverage: float) -> int:
    """How many of a template's words a find may lack."""
    return int((1 - coverage) * len(words) + 1e-9)


class Scanner:
    """Templates with the words by which they are looked for."""

    def __init__(self, found: list[tuple[str, list[str]]] | None = None, coverage: float = 0.9):
        self.templates = found or templates()
        total = Counter(w for _, ws in self.templates for w in set(ws))
        #: The words of each template that are in the fewest templates, the longest of them: one more than may be missing.
        self.seeds = [sorted(set(ws), key=lambda w: (total[w] if len(w) > 2 else 99, -len(w), w))[: 1 + may_miss(ws, coverage)] for _, ws in self.templates]
        self.of: dict[str, list[int]] = {}
        for i, seeds in enumerate(self.seeds):
            for s in seeds:
                self.of.setdefault(s, []).append(i)
        self.words = [set(ws) for _, ws in self.templates]

    def regions(self, t: int, words: list[str], p: int, reach: int, miss: int) -> Iterator[tuple[int, int, bool]]:
        """Where template t may stand around its seed at p; copies close together leave no word unique, so narrower ones follow:
        to the next repetition of the seed, and as the seed stands in the template; the last without anchors, if those mislead."""
        template = self.templates[t][1]
        low, high = max(0, p - reach), min(len(words), p + reach)
        yield low, high, True
        same = [q for q in range(low, high) if words[q] == words[p] and q != p]
        narrow = [(p - q - 2 * miss, p - q + len(template) + 2 * miss) for q, w in enumerate(template) if w == words[p]]
        if same:
            yield max((q + 1 for q in same if q < p), default=low), min((q for q in same if q > p), default=high), True
            yield from ((a, b, True) for a, b in narrow)
        yield from ((a, b, False) for a, b in narrow)

    def scan(self, text: str | None, coverage: float) -> list[tuple[str, int, int, float]]:
        """(license, start, stop, coverage) of the finds, in order."""
        if not text:
            return []
        # a template of which too many words are nowhere in the text can't be covered
        there = set(WORD.findall(text.lower()))
        possible = {t for t, own in enumerate(self.words) if len(own - there) <= may_miss(self.templates[t][1], coverage)}
        if not possible:
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        hits: dict[int, list[int]] = {}
        for p, w in enumerate(words):
            for t in self.of.get(w, ()):
                if t in possible:
                    hits.setdefault(t, []).append(p)
        finds = []
        for t, places in hits.items():
            name, template = self.templates[t]
            reach = len(template) + len(template) // 2 + 4
            miss = may_miss(template, coverage)
            taken: list[tuple[int, int]] = []  # first and last words of this template's finds
            for p in places:
                again = True
                while again and not any(x <= p <= y for x, y in taken):
                    again = False
                    after, before = max((y + 1 for _, y in taken if y < p), default=0), min((x for x, _ in taken if x > p), default=len(words))
                    if len(self.words[t].difference(words[max(after, p - reach) : min(before, p + reach)])) > miss:
                        break
                    for low, high, anchored in self.regions(t, words, p, reach, miss):
                        low, high = max(low, after), min(high, before)
                        region = words[low : max(low, high)]
                        if len(self.words[t].difference(region)) > miss:
                            continue
                        pairs = patience(template, region) if anchored else common(template, region)
                        if len(pairs) >= len(template) - miss:
                            first, last = low + pairs[0][1], low + pairs[-1][1]
                            taken.append((first, last))
                            finds.append((len(pairs), first, last, name, len(pairs) / len(template)))
                            again = True  # the find may be a copy beside the seed's own
                            break
        finds.sort(key=lambda f: (-f[0], f[1], f[3]))
        kept: list[tuple] = []
        for f in finds:
            if all(f[2] < k[1] or f[1] > k[2] for k in kept):
                kept.append(f)
        return [(name, spans[a][0], spans[b][1], share) for _, a, b, name, share in sorted(kept, key=lambda f: f[1])]


def scan(docs: DataFrame, coverage: float = 0.9, id_col: str = "doc_id", text_col: str = "text", more: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, license, start, stop (characters), coverage: one row for each find; more: further (license, text) to look for."""
    id_sql = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates() + [(name, WORD.findall(t.lower())) for name, t in more or []], coverage)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                own = scanner.scan(text.as_py(), coverage)
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]], ["id", "license", "start", "stop", "coverage"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_sql}, license string, start long, stop long, coverage double").withColumnRenamed("id", id_col)
