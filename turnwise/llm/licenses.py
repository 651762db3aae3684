"""License scans by patience alignment of texts with license templates.

Words are runs of letters and digits in lower case. A text is first searched for
places worth aligning: a numpy pass marks words of a template that are rare
among all templates, and a window of the text around them is aligned only if the
distinct words it shares with the template could reach the coverage asked for.

Every window of the template's length over the coverage that begins with a word of
the template is a place, unless one of these bounds rules it out.

Alignment: words occurring once in the window and once in the template are
anchors; the longest increasing subsequence of their positions is kept, and the
gaps between kept anchors are aligned recursively; where a gap has no anchor,
equal words at its start and end are matched. Coverage is the matched share of
the template's words. Of overlapping matches in a text the one with most matched
words is kept (ties: greater coverage, then the name).

A template may have a distinguishing phrase (a name with its version); it must
stand in the matched span word for word, so versions aren't taken for each other.
Notices of a line are the words that every form of them has: what may stand before
("This work is") or behind ("International License") is no part of the match.

Defined cases: null, empty and wordless texts have no match; repeated rows are
scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import words as W
from turnwise.llm.license_bodies import TEXTS

#: Notices of public licenses. Fixed values.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under Creative Commons Attribution-ShareAlike 4.0",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution 4.0",
    "GPL-3.0": "Licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BINARY = " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Words that a match must have in a row, by template.
PHRASES: dict[str, str] = {
    "Apache-2.0": "Apache License, Version 2.0",
    "Apache-2.0-header": "Apache License, Version 2.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0",
    "CC-BY-4.0": "Commons Attribution 4.0",
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-3.0-header": "GNU General Public License as published by the Free Software Foundation, either version 3",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, v. 2.0",
}


def _add(name: str, text: str, phrase: str = "") -> None:
    TEMPLATES[name] = text
    if phrase:
        PHRASES[name] = phrase


_add("BSD-2-text", TEMPLATES["BSD"] + _BINARY + _DISCLAIMER)
_add("BSD-3-text", TEMPLATES["BSD"] + _BINARY + _NAME + _DISCLAIMER, "Neither the name of")
_add(
    "MIT-text",
    TEMPLATES["MIT-notice"] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_add(
    "Zlib",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution.",
)
for _v in ("1.0", "2.0"):
    _add(f"EPL-{_v}", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License v{_v}", f"Eclipse Public License v{_v}")
    _add(f"EPL-{_v}-line", f"Licensed under the Eclipse Public License, version {_v}", f"Eclipse Public License, version {_v}")
_add("CC0-1.0", "Licensed under CC0 1.0", "CC0 1.0")
for _kind, _long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _name = f"CC-{_kind}-{_v}"
        if _name != "CC-BY-NC-4.0":
            _add(_name + "-short", f"Licensed under CC {_kind} {_v}", f"CC {_kind} {_v}")
        if _name not in ("CC-BY-4.0", "CC-BY-SA-4.0"):
            _add(_name + "-long", f"Licensed under Creative Commons Attribution{_long} {_v}", f"Commons Attribution{_long} {_v}")
_add("Apache-2.0-short", "Licensed under the Apache License 2.0", "Apache License 2.0")
for _short, _full, _versions in (("GPL", "General", "1 2 3"), ("LGPL", "Library General", "2"), ("LGPL", "Lesser General", "2.1 3"), ("AGPL", "Affero General", "3")):
    for _v in _versions.split():
        _name = f"{_short}-{_v if '.' in _v else _v + '.0'}"
        _add(_name + "-short", f"Licensed under the GNU {_full} Public License v{_v}", f"GNU {_full} Public License v{_v}")
        if _name != "GPL-3.0":
            _add(_name, f"Licensed under the GNU {_full} Public License, version {_v}", f"GNU {_full} Public License, version {_v}")
            _by = f"GNU {_full} Public License as published by the Free Software Foundation, either version {_v}"
            _add(_name + "-header", f"This program is free software: you can redistribute it and/or modify it under the terms of the {_by} of the License, or (at your option) any later version.", _by)
#: Titles of the whole texts.
_TITLES = {
    "Apache-2.0": "Apache License Version 2.0",
    "Artistic": "Artistic License",
    "CC0-1.0": "CC0 1.0",
    "GFDL-1.2": "GNU Free Documentation License Version 1.2",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3",
    "GPL-1": "GNU General Public License Version 1",
    "GPL-2": "GNU General Public License Version 2",
    "GPL-3": "GNU General Public License Version 3",
    "LGPL-2": "GNU Library General Public License Version 2",
    "LGPL-2.1": "GNU Lesser General Public License Version 2.1",
    "LGPL-3": "GNU Lesser General Public License Version 3",
    "MPL-1.1": "Mozilla Public License Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
for _name, _title in _TITLES.items():
    _add(_name + "-text", TEXTS[_name], _title)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        pairs = sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b)
        anchors = _increasing(pairs)
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def _once(x: list[int], begin: int, end: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for k in range(begin, end):
        seen[x[k]] = -1 if x[k] in seen else k
    return {v: k for v, k in seen.items() if k >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs that increases in the second place."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, phrases: dict[str, str] | None = None):
        self.coverage = coverage
        self.names = list(templates)
        raw = [np.frombuffer(t.encode(), np.uint8) for t in templates.values()]
        self.words = [W.Words(r, np.array([0, len(r)]), letters=True).hash for r in raw]
        self.lists = [h.tolist() for h in self.words]
        raw = [np.frombuffer((phrases or {}).get(t, "").encode(), np.uint8) for t in templates]
        self.phrases = [W.Words(r, np.array([0, len(r)]), letters=True).hash for r in raw]
        self.vocabulary, self.used = np.unique(np.concatenate([np.unique(h) for h in self.words]), return_counts=True)
        self.ids = [np.searchsorted(self.vocabulary, h) for h in self.words]
        self.least = [int(np.ceil(coverage * len(h))) for h in self.words]
        self.counts = [np.bincount(x, minlength=len(self.vocabulary)) for x in self.ids]
        # of each template, so many words in fewest templates that a match must have one of them
        self.keys = []
        for ids, least in zip(self.ids, self.least, strict=True):
            distinct, count = np.unique(ids, return_counts=True)
            order = np.lexsort((distinct, self.used[distinct]))
            need = int(count.sum()) - least + 1
            take = int(np.searchsorted(np.cumsum(count[order]), need)) + 1
            self.keys.append(np.sort(distinct[order[:take]]))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, name, coverage, matched, first word, words) of a run of texts."""
        w = W.Words(data, offsets, letters=True)
        if not len(w):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[at] == w.hash, at, -1)
        places = np.flatnonzero(known >= 0)
        at = at[places]
        said: dict[bytes, np.ndarray] = {}
        found: dict[int, list[tuple]] = {}
        for t, (ids, keys, least) in enumerate(zip(self.ids, self.keys, self.least, strict=True)):
            phrase = self.phrases[t]
            if len(phrase):
                key_of = phrase.tobytes()
                if key_of not in said:
                    said[key_of] = _runs(w.hash, phrase)
                if not len(said[key_of]):
                    continue
            mine = self.counts[t][at] > 0
            p, row = places[mine], w.row[places[mine]]
            if len(p) < least:
                continue
            span = int(len(ids) / self.coverage) + 2
            # a place with enough of the template's words within the span after it
            enough = np.searchsorted(p, p + span) - np.arange(len(p)) >= least
            key = np.isin(at[mine], keys)
            near = np.searchsorted(p[key], p + span) > np.searchsorted(p[key], p)
            start = np.flatnonzero(enough & near)
            last = -1
            for k in start.tolist():
                a = int(p[k])
                if a < last:
                    continue
                r = int(row[k])
                b = min(a + 2 * span, int(w.first[r + 1]))
                if len(phrase):
                    where = said[key_of]
                    q = int(np.searchsorted(where, a))
                    if q == len(where):
                        break
                    # the next place whose window has the whole phrase
                    if where[q] + len(phrase) > a + span:
                        last = int(where[q]) + len(phrase) - span
                        continue
                words = known[a : min(a + span, b)]
                shared = int(np.minimum(np.bincount(words[words >= 0], minlength=len(self.vocabulary)), self.counts[t]).sum())
                if shared < least:  # each word further on brings one more at most, within this text
                    last = min(a + least - shared, int(w.first[r + 1]))
                    continue
                got = self._best(w.hash[a:b].tolist(), t)
                if got is None:
                    continue
                share, matched, i, n = got
                found.setdefault(r, []).append((matched, share, self.names[t], a + i - int(w.first[r]), n))
                last = a + i + n
        out = []
        for r, hits in sorted(found.items()):
            kept: list[tuple] = []
            for hit in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[3])):
                if all(hit[3] + hit[4] <= x[3] or x[3] + x[4] <= hit[3] for x in kept):
                    kept.append(hit)
            out += [(r, h[2], h[1], h[0], h[3], h[4]) for h in sorted(kept, key=lambda h: h[3])]
        return out

    def _best(self, window: list[int], t: int):
        """Coverage, matched words and span of the template at the window's start."""
        template = self.lists[t]
        limit = int(len(template) / self.coverage) + 2
        pairs = patience(window[:limit], template)
        if len(pairs) < self.least[t]:
            return None
        i, end = pairs[0][0], pairs[-1][0] + 1
        if len(self.phrases[t]) and not len(_runs(np.array(window[i:end], np.uint64), self.phrases[t])):
            return None
        return len(pairs) / len(template), len(pairs), i, end - i


def _runs(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the words of ``phrase`` follow each other."""
    at = np.flatnonzero(h[: max(len(h) - len(phrase) + 1, 0)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at


def scan_licenses(docs: DataFrame, coverage: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, matched, first_word, n_words) of all matches."""
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, coverage, None if templates else PHRASES))
    names = ["doc_id", "license", "coverage", "matched", "first_word", "n_words"]

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            for i, j in W.chunked(offsets):
                found = sent.value.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if found:
                    row, name, share, matched, first, n = zip(*found, strict=True)
                    longs = [pa.array(x, pa.int64()) for x in (matched, first, n)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(name), pa.array(share), *longs], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, matched long, first_word long, n_words long")
