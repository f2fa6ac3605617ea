"""License notices in documents, by patience alignment with templates.

A template is aligned with the words of a document around its cue words: words unique to both sides
are the anchors, their longest increasing subsequence is kept, and the gaps between are aligned the
same way; a gap without anchors (as in a notice that is repeated) is aligned by an exact longest common
subsequence. The share of the template's words that are matched is the coverage. Anchors may miss a
better alignment where words were added and dropped; a place that falls short is checked by the length of
the exact longest common subsequence, and aligned by that if it suffices.

Cue words make the scan lossless: a template of m words that must be covered to ceil(share * m)
words matches at least one of any m - ceil(share * m) + 1 of its words, and its longest such words
are looked for. Only documents with a cue are split into words at all.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, utf8_view

SHARE = 0.8
#: Windows of one text whose alignment is kept at once.
KNOWN = 4096
_WORDS = re.compile(r"\w+")

#: Texts of public notices (fixed values); beside whole ones (-full, -Clause) the parts of them that often stand alone.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-full": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p:
            back[i] = at[p - 1]
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """A longest common subsequence of (word, place) lists, as matched places."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, w = size[i], size[i + 1], a[i][0]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if w == b[j][0] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while size[i][j]:
        if a[i][0] == b[j][0]:
            out.append((a[i][1], b[j][1]))
            i, j = i + 1, j + 1
        elif size[i + 1][j] > size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def common_length(places: dict[str, int], m: int, b: list[str]) -> int:
    """Length of a longest common subsequence of a template of m words, given by its words' places as bits, and b."""
    full = row = (1 << m) - 1
    for w in b:
        both = row & places.get(w, 0)
        row = (row + both | row - both) & full
    return m - row.bit_count()


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) in rising order. Gaps wait on a list, so depth is not bounded by a call stack."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [unique[i] for i in longest_rise([j for _, j in unique])]
        if not anchors:
            out += common([(w, i) for i, w in enumerate(a[a0:a1], a0) if w in in_b], [(w, j) for j, w in enumerate(b[b0:b1], b0) if w in in_a])
            continue
        out += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if x0 + 1 < x1 and y0 + 1 < y1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def _spread(place: tuple[int, int], hits: Iterable[tuple[int, int]]) -> bool:
    """Whether shorter hits that don't overlap each other lie at a (first word, words) place: it mixes several copies."""
    near = [(x, x + n) for x, n in hits if n < place[1] and x < place[0] + place[1] and x + n > place[0]]
    return bool(near) and min(y for _, y in near) <= max(x for x, _ in near)


class _Shared:
    """Words that a window which only moves forward shares with a template, each as often as in both."""

    def __init__(self, words: list[str], bag: dict[str, int]) -> None:
        self.words, self.bag, self.a, self.b, self.n, self.total = words, bag, 0, 0, Counter(), 0

    def at(self, a: int, b: int) -> int:
        if a >= self.b:
            self.a = self.b = a
            self.n, self.total = Counter(), 0
        for w in self.words[self.b : b]:
            if w in self.bag:
                self.n[w] += 1
                self.total += self.n[w] <= self.bag[w]
        for w in self.words[self.a : a]:
            if w in self.bag:
                self.total -= self.n[w] <= self.bag[w]
                self.n[w] -= 1
        self.a, self.b = a, max(b, self.b)
        return self.total


class Scanner:
    """Templates with their cue words."""

    def __init__(self, templates: dict[str, str], share: float = SHARE) -> None:
        self.share, self.templates = share, []
        cues: set[str] = set()
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if not words:
                continue
            need = max(1, math.ceil(share * len(words) - 1e-9))
            chosen = sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[: len(words) - need + 1]
            at: dict[str, list[int]] = {}
            for i in chosen:
                at.setdefault(words[i], []).append(i)
            bits: dict[str, int] = {}
            for i, w in enumerate(words):
                bits[w] = bits.get(w, 0) | 1 << i
            self.templates.append((name, words, at, need, bits))
            cues |= set(at)
        self.cue = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(cues))) + r")\b") if cues else None

    @staticmethod
    def _matched(want: list[str], bits: dict[str, int], need: int, window: list[str], known: dict[tuple[str, ...], tuple[int, int, int] | None]) -> tuple[int, int, int] | None:
        """(first word, words, matched words) of the template in a window, None where too few match; equal windows are aligned once.

        The length of a longest common subsequence bounds what any alignment matches, and is far cheaper to have.
        """
        key = tuple(window)
        if key not in known:
            if len(known) == KNOWN:
                known.clear()
            known[key] = None
            if common_length(bits, len(want), window) >= need:
                hit = align(want, window)
                if len(hit) < need:
                    hit = common([(w, i) for i, w in enumerate(want)], [(w, i) for i, w in enumerate(window) if w in bits])
                known[key] = hit[0][1], hit[-1][1] - hit[0][1] + 1, len(hit)
        return known[key]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, words) of every notice, in text order.

        Of overlapping ones that with most matched words counts, less half of the words inside it that match nothing.
        """
        lowered = text.lower()
        if self.cue is None or not self.cue.search(lowered):
            return []
        words = _WORDS.findall(lowered)
        places: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            places.setdefault(w, []).append(p)
        found = []
        for name, want, at, need, bits in self.templates:
            starts = sorted({p - i for w, own in at.items() for p in places.get(w, ()) for i in own})
            slack, m, i = len(want) // 4 + 2, len(want), 0
            bag, hits = Counter(want), {}
            known: dict[tuple[str, ...], tuple[int, int, int] | None] = {}
            while i < len(starts):
                # Starts within one slack of each other belong to one place; a run of them is cut at a template's length.
                j = i
                while j + 1 < len(starts) and starts[j + 1] - starts[j] <= slack and starts[j + 1] - starts[i] <= m:
                    j += 1
                a, b = max(0, starts[i] - slack), min(len(words), starts[j] + m + slack)
                if sum((Counter(words[a:b]) & bag).values()) >= need:
                    # The run as a whole, and a template's length from every start for copies that follow one another.
                    shared = _Shared(words, bag)
                    for a, b in ((a, b), *((max(0, s), min(len(words), s + m)) for s in starts[i : j + 1] if shared.at(max(0, s), min(len(words), s + m)) >= need)):
                        hit = self._matched(want, bits, need, words[a:b], known)
                        if hit:
                            place = a + hit[0], hit[1]
                            hits[place] = max(hit[2], hits.get(place, 0))
                i = j + 1
            found += [(n, name, round(n / m, 4), *place) for place, n in hits.items() if place[1] <= m or not _spread(place, hits)]
        taken: list[tuple[int, int]] = []
        out = []
        for _, name, share, first, n in sorted(found, key=lambda f: (f[4] - 3 * f[0], f[3], f[4], f[1])):
            if all(first + n <= x or first >= x + y for x, y in taken):
                taken.append((first, n))
                out.append((name, share, first, n))
        return sorted(out, key=lambda f: f[2])


_KIND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("words", pa.int32())]))


def _scan(templates: dict[str, str], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, share)
        for batch in batches:
            text = batch.column("__tf_text")
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__tf_text"]
            _, off = utf8_view(text)
            for a, b in slices(off, SLICE_BYTES * 4):
                found = [scanner.scan(t or "") for t in text.slice(a, b - a).to_pylist()]
                spans = pa.array([[dict(zip(("license", "coverage", "first_word", "words"), f)) for f in row] for row in found], _KIND)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in keep), spans], [*(batch.schema.names[i] for i in keep), "spans"])

    return run


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """docs without the text but with license, coverage, n_spans and spans (earlier columns of these names are replaced).

    license and coverage are those of the notice with most matched words (the first of equal ones),
    null if there is none. Null and empty texts have no spans. Rows repeat and stay; templates
    without words are ignored. Nothing is shuffled.
    """
    new = ("license", "coverage", "n_spans", "spans")
    own = [c for c in docs.columns if c not in (text, *new)]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(text).cast("string").alias("__tf_text"))
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    out = rows.mapInArrow(_scan(TEMPLATES if templates is None else templates, share), fields + "spans array<struct<license:string,coverage:double,first_word:int,words:int>>")
    main = F.try_element_at(F.array_sort("spans", lambda x, y: F.coalesce(F.nullif(F.signum(y["words"] * y["coverage"] - x["words"] * x["coverage"]).cast("int"), F.lit(0)), x["first_word"] - y["first_word"])), F.lit(1))
    return out.withColumn("__tf_main", main).select(*[F.col(f"`{c}`") for c in own], F.col("__tf_main.license").alias("license"), F.col("__tf_main.coverage").alias("coverage"), F.size("spans").alias("n_spans"), "spans")
