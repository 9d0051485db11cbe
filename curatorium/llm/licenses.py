"""License scans by patience alignment with license templates.

1. A batch of texts is cut into words (lower case, no punctuation at the edges) as flat arrays of hashes; one lookup marks
   the words that any template has.  A template can only reach its coverage if the words it shares with the text weigh
   enough, which rules out nearly all texts without an alignment.
2. In the others, runs of template words (gaps of at most ``GAP`` other words, or half the template's length) are the regions.  A region that starts with
   enough shared words is aligned with the template: words unique to both are anchors, their longest increasing
   subsequence is kept, and the gaps between anchors are aligned in the same way, down to equal words at either end.
3. Coverage is the share of template words that were aligned.  Where another license's text would cover a template as well,
   the words that this one has and the other lacks must be aligned too, all of them or, if many, the same share of them.
   Of overlapping finds the one with more aligned words stays, so a notice beats one that it contains.
4. A tag ("SPDX-License-Identifier: MIT") is a template of two words that must stand side by side.

The templates are a bounded parameter that goes along with the code.  Nothing is shuffled.  Defined cases: null, empty and
license-free texts have an empty list; a license named twice is found twice; repeated rows are scanned alike; templates
without words are ignored; equal templates give the first one; other columns pass through (one named like a result is replaced).
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import Carried

# Fixed texts: notices of common licenses, as their authors word them.
_GNU = "{this} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AUTHOR = "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_TERMS = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_TERMS = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _gnu(kind: str, version: str, *subjects: str) -> list[str]:
    """The usual notice of a GNU license, in the punctuation of its version."""
    mark = (":", ",") if version == "3" else (";", ";")
    return [_GNU.format(this=f"This {subject}", kind=kind, version=version, a=mark[0], b=mark[1]) for subject in subjects]


TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT_TERMS, f"{_MIT_TERMS} {_MIT_WARRANTY}"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_gnu("", "3", "program")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_gnu("", "2", "program")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser ", "3", "program", "library")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser ", "2.1", "library")],
    "LGPL-2.0": ["This work is licensed under the GNU Library General Public License, version 2.", *_gnu("Library ", "2", "library")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero ", "3", "program")],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_TERMS, f"{_BSD_TERMS} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", f"{_BSD_TERMS} {_BSD_NAMES}", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}", f"{_BSD_TERMS} {_BSD_AUTHOR}",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [_ISC_TERMS, f"{_ISC_TERMS} {_ISC_WARRANTY}"],
    "0BSD": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
}
# Every license may also be named by its tag.
_FAMILIES = ("GPL", "LGPL", "AGPL")
for _name, _texts in TEMPLATES.items():
    _tails = ("", "-only", "-or-later") if _name.startswith(_FAMILIES) else ("",)
    _texts += [f"SPDX-License-Identifier: {_name}{tail}" for tail in _tails]
COVERAGE = 0.8
#: Templates of at most so many words must be aligned whole: one word is the difference between two licenses there.
SHORT = 16
#: Templates of at most so many words are tags: nothing may come between their words.
TAG = 2
GAP = 12


@dataclass
class Template:
    license: str
    words: list[int]


class Templates:
    """Hashed templates and the weights of their words."""

    def __init__(self, texts: dict[str, list[str]]):
        named = [(name, text) for name, group in texts.items() for text in group]
        hashes, first = W.plain_words(pa.array([t for _, t in named], pa.string()))
        self.all = [Template(n, hashes[a:b].tolist()) for (n, _), a, b in zip(named, first[:-1], first[1:]) if b > a]
        self.vocabulary = np.unique(np.concatenate([np.array(t.words, np.uint64) for t in self.all])) if self.all else np.zeros(0, np.uint64)
        self.weights = np.zeros((len(self.all), len(self.vocabulary)), np.float32)
        for k, template in enumerate(self.all):
            np.add.at(self.weights[k], np.searchsorted(self.vocabulary, np.array(template.words, np.uint64)), 1)
        self.sizes = self.weights.sum(axis=1)
        self.needed = np.array([needed(len(t.words)) for t in self.all])
        self.telling = [self._telling(k) for k in range(len(self.all))]

    def _telling(self, k: int) -> list[frozenset[int]]:
        """Per template of another license that would pass for this one: the words of this one that the other lacks."""
        own, out = self.all[k], []
        for j in np.flatnonzero(np.minimum(self.weights, self.weights[k]).sum(axis=1) >= self.needed[k]):
            if self.all[j].license != own.license:
                shared = {q for _, q in patience(self.all[j].words, own.words)}
                if len(shared) >= self.needed[k] and len(shared) < len(own.words):
                    out.append(frozenset(range(len(own.words))) - shared)
        return out

    def tells(self, k: int, aligned: set[int]) -> bool:
        """Whether the aligned words of template k rule out every license that it could be taken for."""
        return all(len(words & aligned) >= needed(len(words)) for words in self.telling[k])


def needed(words: int) -> int:
    """Template words that must be aligned."""
    return words if words <= SHORT else int(np.ceil(COVERAGE * words))


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _increasing([(i, j) for i, j in _unique_to_both(a, a0, a1, b, b0, b1)])
        if not anchors:
            continue
        out.extend(anchors)
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if i + 1 < k and j + 1 < m)
    return sorted(out)


def _unique_to_both(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Places of the words that occur once on either side, in the order of ``a``."""

    def once(words, lo, hi):
        at: dict = {}
        for i in range(lo, hi):
            at[words[i]] = -1 if words[i] in at else i
        return at

    left, right = once(a, a0, a1), once(b, b0, b1)
    return [(i, right[w]) for w, i in left.items() if i >= 0 and right.get(w, -1) >= 0]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence with rising second places: patience sorting with links back."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = ends[pile - 1] if pile else -1
        tops[pile : pile + 1] = [j]
        ends[pile : pile + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def regions(marked: np.ndarray, gap: int = GAP) -> list[tuple[int, int]]:
    """Runs of template words with at most ``gap`` other words in between."""
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist()))


def find(words: np.ndarray, templates: Templates, candidates) -> list[tuple[str, int, int, int, int]]:
    """(license, first word, end word, aligned, template words) in one text, by place."""
    found = []
    for k in candidates:
        template = templates.all[k]
        size = len(template.words)
        if size <= TAG:
            at = np.arange(max(0, len(words) - size + 1))
            for i, word in enumerate(template.words):
                at = at[words[at + i] == np.uint64(word)]
            found += [(template.license, int(i), int(i) + size, size, size, k) for i in at]
            continue
        own = np.isin(words, np.array(template.words, np.uint64))
        least = int(templates.needed[k])
        for lo, hi in regions(own, max(GAP, size // 2)):
            # a long region may hold several copies: look again behind each one found
            while hi - lo >= least:
                if np.count_nonzero(own[lo:hi]) < least:
                    break
                pairs = _best_window(words[lo:hi].tolist(), template.words, least)
                if pairs is None:
                    break
                if templates.tells(k, {q for _, q in pairs}):
                    found.append((template.license, lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs), size, k))
                lo += pairs[-1][0] + 1
    found.sort(key=lambda f: (-f[3], f[5], f[1]))
    kept: list = []  # disjoint, so in order of their starts and of their ends
    for f in found:
        i = bisect_left(kept, f[1], key=lambda g: g[2] - 1)
        if i == len(kept) or f[2] <= kept[i][1]:
            kept.insert(i, f)
    return [f[:5] for f in kept]


def _best_window(text: list, template: list, least: int):
    """Aligned pairs of the first window of the region that the template covers, or None.

    Windows of twice the template's length start at half-length steps, so a copy with up to half as many words put in lies
    inside one of them, and a second copy doesn't hide the words unique to the first.
    """
    size = 2 * len(template)
    step = max(1, len(template) // 2)
    for at in range(0, max(1, len(text) - least + 1), step):
        pairs = patience(text[at : at + size], template)
        if len(pairs) >= least:
            # the same copy may be seen better a little further on
            start = at + pairs[0][0]
            better = patience(text[start : start + size], template)
            return [(start + i, j) for i, j in better] if len(better) > len(pairs) else [(at + i, j) for i, j in pairs]
    return None


_FIND = "array<struct<license:string,start:int,end:int,aligned:int,words:int>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("aligned", pa.int32()), ("words", pa.int32())]))


def find_licenses(docs: DataFrame, text: str = "text", texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``docs`` without its text and with ``licenses``: license, word span, aligned words and template words of every find."""
    kept = Carried(docs, text, "body", ["licenses"])
    names, fields = kept.names, ["license", "start", "end", "aligned", "words"]

    def run(batches):
        templates = Templates(texts)
        for batch in batches:
            for part in W.slices(batch, "body"):
                out = [[] for _ in range(part.num_rows)]
                words, first = W.plain_words(part.column("body"))
                if len(words) and len(templates.all):
                    place = np.minimum(np.searchsorted(templates.vocabulary, words), len(templates.vocabulary) - 1)
                    hits = np.flatnonzero(templates.vocabulary[place] == words)
                    rows = np.searchsorted(first, hits, side="right") - 1
                    present = np.zeros((part.num_rows, len(templates.vocabulary)), np.float32)
                    present[rows, place[hits]] = 1
                    possible = present @ templates.weights.T >= templates.needed - 1e-3
                    for row in np.flatnonzero(possible.any(axis=1)):
                        own = words[first[row] : first[row + 1]]
                        out[row] = [dict(zip(fields, f)) for f in find(own, templates, np.flatnonzero(possible[row]))]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(out, _ARROW)], [*names, "licenses"])

    return kept.back(kept.plain.mapInArrow(run, kept.schema(f"licenses {_FIND}")), "licenses")


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), x["aligned"].cast("string")))
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )
