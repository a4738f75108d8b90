"""License scan by Patience alignment.

A text's words are aligned with each template: words that occur once on either side are anchors, the longest increasing
run of them is kept, and the gaps between them are aligned the same way; a gap without anchors gets its longest common
subsequence. Coverage is the share of the template's words that were aligned. Null and empty texts match nothing. Every row
gives one row, rows that repeat an id and rows with a null id too; of regions of equal coverage the first counts, of
templates of equal coverage the longest is the best. Other columns stay out. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import id_text, map_rows

TOKEN = re.compile(r"[\w.+-]+")

# The wording of public licences and of their notices.
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause": f"{BSD_CONDITIONS} {BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{BSD_CONDITIONS} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_DISCLAIMER}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def tokens(text: str) -> list[str]:
    return [w.strip(".-+") or w for w in TOKEN.findall(text.lower())]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rising(at: list[int]) -> list[int]:
    """Indices of a longest strictly increasing run of distinct numbers, by piles."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, x in enumerate(at):
        p = bisect.bisect_left(tops, x)
        back.append(last[p - 1] if p else -1)
        tops[p : p + 1], last[p : p + 1] = [x], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> int:
    """Words of the template that a Patience alignment pairs with words of the text."""
    total, work = 0, [(0, len(text), 0, len(template))]
    while work:
        i, j, p, q = work.pop()
        while i < j and p < q and text[i] == template[p]:
            i, p, total = i + 1, p + 1, total + 1
        while i < j and p < q and text[j - 1] == template[q - 1]:
            j, q, total = j - 1, q - 1, total + 1
        if i == j or p == q:
            continue
        n, m = Counter(text[i:j]), Counter(template[p:q])
        once = {w: p + k for k, w in enumerate(template[p:q]) if m[w] == 1 and n[w] == 1}
        pairs = [(i + k, once[w]) for k, w in enumerate(text[i:j]) if w in once]
        if not pairs:
            total += common_subsequence(template[p:q], text[i:j])
            continue
        for k in rising([y for _, y in pairs]):
            x, y = pairs[k]
            work.append((i, x, p, y))
            i, p, total = x + 1, y + 1, total + 1
        work.append((i, j, p, q))
    return total


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = {k: tokens(v) for k, v in templates.items()}
        # Of so many words of a template at least one is aligned where coverage reaches `least`; the longest are the rarest.
        self.seeds: dict[str, dict[str, list[int]]] = {}
        for name, t in self.templates.items():
            spare = int(len(t) * (1 - least) + 1e-9) + 1
            for i in sorted(range(len(t)), key=lambda i: (-len(t[i]), i))[:spare]:
                self.seeds.setdefault(t[i], {}).setdefault(name, []).append(i)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first and last word of the region) of each template that the text covers, best region first."""
        found = tokens(text)
        if self.seeds.keys().isdisjoint(found):
            return []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(found):
            for name in self.seeds.get(w, ()):
                at.setdefault(name, []).append(i)
        out = []
        for name, hits in sorted(at.items()):
            t = self.templates[name]
            best = (0.0, 0, 0)
            for lo, hi in regions(hits, len(t), len(found)):
                c = aligned(found[lo:hi], t) / len(t)
                if c > best[0]:
                    best = (c, lo, hi)
            if best[0] >= self.least:
                out.append((name, *best))
        return out


def regions(hits: list[int], n: int, length: int) -> list[tuple[int, int]]:
    """Regions around the seeds, each up to 4 n words long with half of it shared with the next, that hold any near match."""
    spans: list[list[int]] = []
    for h in hits:
        if spans and h - 2 * n <= spans[-1][1]:
            spans[-1][1] = h + 2 * n
        else:
            spans.append([h - 2 * n, h + 2 * n])
    return [(max(0, s), min(length, s + 4 * n)) for lo, hi in spans for s in range(lo, max(lo + 1, hi - 2 * n), 2 * n)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per document: the templates covered to `least` or more, in order of name, with their coverage; the best one, of
    equals the longest (a licence may hold another one whole)."""
    scanner = Scanner(templates or TEMPLATES, least)

    def start():
        def step(batch):
            got = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            best = [max(g, key=lambda x: (x[1], len(scanner.templates[x[0]])), default=(None, 0.0, 0, 0)) for g in got]
            return {
                "doc_id": batch.column(0), "n_licenses": [len(g) for g in got], "licenses": [",".join(x[0] for x in g) for g in got], "coverages": [[x[1] for x in g] for g in got],
                "best_license": [b[0] for b in best], "best_coverage": [b[1] for b in best],
            }

        return step

    return map_rows(id_text(docs, id_col, text_col), "doc_id long, n_licenses long, licenses string, coverages array<double>, best_license string, best_coverage double", start)
