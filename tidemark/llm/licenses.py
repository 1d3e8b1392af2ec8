"""License scan by patience alignment.

A text and a license template are aligned on anchors: words that occur once in both. The longest run of anchors that
ascends in both texts is kept; the gaps between them are aligned in the same way. Where a gap has no such word, its
longest common run of words is the anchor. The share of the template's words that are aligned is its coverage.

A document is first cut to windows around the rarest words of a template. These are so many that no text without any of them
reaches the required coverage, so no match is lost, and a notice far down in a long text costs as much as a
short text. After a match the rest of the window is searched again.

Edge cases: null or empty text has no license; a license that stands twice is found twice; of matches of several templates that
overlap the one that covers more words wins (only matches that hold the phrases of IDENTITY count), ties going to the earlier template; repeated rows are scanned each; an empty table
gives no rows. Places are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import text_of

#: License texts and customary notices, in the words of the licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
_GNU = TEMPLATES["GPL-3.0 header"]
_GNU_NAME = "GNU General Public License"
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES |= {
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "BSD notice": "Released under the BSD License.",
    "ISC notice": "Released under the ISC License.",
    "Unlicense notice": "Released under the Unlicense.",
    **{f"CC-{x}-4.0": f"Licensed under CC {x} 4.0." for x in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "GPL-2.0": f"This work is licensed under the {_GNU_NAME}, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0 header": _GNU.replace("version 3", "version 2"),
    "LGPL-2.1 header": _GNU.replace("version 3", "version 2.1").replace("program", "library").replace("General Public", "Lesser General Public"),
    "LGPL-3.0 header": _GNU.replace("General Public", "Lesser General Public"),
    "AGPL-3.0 header": _GNU.replace("General Public", "Affero General Public"),
    "ISC text": (
        TEMPLATES["ISC"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause text": TEMPLATES["BSD"] + " " + _WARRANTY,
    "BSD-3-Clause text": (
        TEMPLATES["BSD"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. " + _WARRANTY
    ),
}
#: Phrases (several forms parted by |) that a match must hold as they are: what tells a license from its neighbours.
IDENTITY = {
    "Apache-2.0": ["apache license", "version 2.0|version 2"],
    "MIT": ["mit license"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0"],
    "GPL-3.0": ["gnu general public license", "version 3|version 3.0"],
    "Apache-2.0 header": ["apache license", "version 2.0|license-2.0"],
    "GPL-3.0 header": ["gnu general public license", "version 3|version 3.0"],
    "Apache-1.1": ["apache license", "version 1.1"],
    "MPL-2.0 notice": ["mozilla public license", "version 2.0|version 2"],
    "BSD notice": ["bsd license"],
    "ISC notice": ["isc license"],
    "Unlicense notice": ["the unlicense"],
    **{f"CC-{x}-4.0": [f"cc {x.lower()} 4.0"] for x in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"GPL-2.0{x}": ["gnu general public license", "version 2|version 2.0"] for x in ("", " header")},
    **{f"LGPL-2.1{x}": ["gnu lesser general public license", "version 2.1"] for x in ("", " header")},
    **{f"LGPL-3.0{x}": ["gnu lesser general public license", "version 3|version 3.0"] for x in ("", " header")},
    **{f"AGPL-3.0{x}": ["gnu affero general public license", "version 3|version 3.0"] for x in ("", " header")},
    "BSD-3-Clause text": ["neither the name|names of its|endorse or promote|promote products derived"],
}
COVERAGE = 0.8
#: Words that any text may hold; not used to find windows unless a template needs them.
COMMON = {"a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "for", "from", "if", "in", "is", "it", "not", "of", "on", "one", "or", "that", "the", "this", "to", "use", "was", "with", "you"}
_TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; punctuation does not count, version numbers stay whole."""
    return [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) that also ascends in the second, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common_run(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Start in a, start in b, and length of the longest common run; the first one of several."""
    best, last = (0, 0, 0), {}
    for i, w in enumerate(a):
        now = {}
        for j, x in enumerate(b):
            if w == x:
                n = now[j] = last.get(j - 1, 0) + 1
                if n > best[2]:
                    best = (i - n + 1, j - n + 1, n)
        last = now
    return best


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) of aligned words, ascending in both."""
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
        x, y = a[a0:a1], b[b0:b1]
        in_x, in_y = Counter(x), Counter(y)
        place = {w: j for j, w in enumerate(y) if in_y[w] == 1}
        anchors = _rising([(i, place[w]) for i, w in enumerate(x) if in_x[w] == 1 and w in place])
        if not anchors:
            i, j, n = _common_run(x, y)
            anchors = [(i + k, j + k) for k in range(n)]
        if not anchors:
            continue
        last = (-1, -1)
        for i, j in [*anchors, (len(x), len(y))]:
            todo.append((a0 + last[0] + 1, a0 + i, b0 + last[1] + 1, b0 + j))
            last = (i, j)
        out += [(a0 + i, b0 + j) for i, j in anchors]
    return sorted(out)


@lru_cache(maxsize=4)
def compiled(items: tuple[tuple[str, str], ...], coverage: float):
    """name, words, words to look for: missing all of these keeps a text below the coverage."""
    seen = Counter(w for _, t in items for w in {w for w, _, _ in tokens(t)})
    out = []
    for name, t in items:
        words = [w for w, _, _ in tokens(t)]
        need = len(words) - coverage * len(words)  # more words than this must be looked for
        keys: set[str] = set()
        for w in sorted(set(words), key=lambda w: (w in COMMON, seen[w], -len(w), w)):
            if sum(x in keys for x in words) > need:
                break
            keys.add(w)
        out.append((name, words, frozenset(keys)))
    return out


def _identified(name: str, words: list[str]) -> bool:
    line = f" {' '.join(words)} "
    return all(any(f" {form} " in line for form in phrase.split("|")) for phrase in IDENTITY.get(name, ()))


def scan_text(text: str, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items()), coverage: float = COVERAGE) -> list[tuple[int, int, str, float]]:
    """(start, end, license, coverage) of all matches, by place."""
    low = text.lower()
    ready = [(k, t) for k, t in enumerate(compiled(templates, coverage)) if any(w in low for w in t[2])]
    if not ready:
        return []
    words = tokens(text)
    plain = [w for w, _, _ in words]
    where: dict[str, list[int]] = {}
    wanted = frozenset().union(*(t[2] for _, t in ready))
    for i, w in enumerate(plain):
        if w in wanted:
            where.setdefault(w, []).append(i)
    found = []
    for order, (name, template, keys) in ready:
        n = len(template)
        spots = sorted(i for w in keys for i in where.get(w, ()))
        windows: list[list[int]] = []
        for i in spots:  # spots within a template's length of each other share a window
            if windows and i - windows[-1][1] <= n:
                windows[-1][1] = i
            else:
                windows.append([i, i])
        # a window of very many spots is cut to overlapping ones, each with room for a whole template
        todo = []
        for a, b in windows:
            for c in range(a, b + 1, 4 * n):
                todo.append((max(0, c - n), min(len(plain), min(c + 5 * n, b) + n + 1)))
        taken: set[tuple[int, int]] = set()
        while todo:
            a, b = todo.pop()
            if b - a < coverage * n:
                continue
            pairs = align(plain[a:b], template)
            # aligned words with large holes between them are not one passage
            runs: list[list[tuple[int, int]]] = []
            for p in pairs:
                if runs and p[0] - runs[-1][-1][0] <= 3 + n // 4:
                    runs[-1].append(p)
                else:
                    runs.append([p])
            best = max(runs, key=len, default=[])
            if len(best) < coverage * n:
                # a second copy beside it may have hidden every anchor: halves, while they can hold a template
                if b - a > 2 * n and sum(x in keys for x in plain[a:b]) > 1:
                    mid = (a + b) // 2
                    todo += [(a, min(b, mid + n // 2 + 1)), (max(a, mid - n // 2), b)] if b - a > 3 * n else [(a, a + 3 * n // 2), (b - 3 * n // 2, b)]
                continue
            i, j = a + best[0][0], a + best[-1][0] + 1
            # the version may stand right behind the last aligned word, in another form
            if (i, j) not in taken and _identified(name, plain[i : j + 1]):
                taken.add((i, j))
                found.append((len(best), -order, i, j, name, len(best) / n))
            todo += [(a, i), (j, b)]
    kept: list[tuple[int, int, str, float]] = []
    busy: list[tuple[int, int]] = []
    for _, _, i, j, name, share in sorted(found, key=lambda f: (-f[0], -f[1], f[2])):
        k = bisect_left(busy, (i, j))
        if (k < len(busy) and busy[k][0] < j) or (k and busy[k - 1][1] > i):
            continue
        busy.insert(k, (i, j))
        kept.append((words[i][1], words[j - 1][2], name, share))
    return sorted(kept)


def report(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_licenses, licenses (names by place) and spans (start:end:coverage in percent by place), one row per document."""
    items = tuple((templates or TEMPLATES).items())

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                hits = [scan_text(t, items, coverage) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(h) for h in hits], pa.int64()), pa.array([",".join(x[2] for x in h) for h in hits]),
                        pa.array([",".join(f"{a}:{b}:{int(100 * s + 0.5)}" for a, b, _, s in h) for h in hits]),
                    ],
                    names=["doc_id", "n_licenses", "licenses", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_licenses long, licenses string, spans string")
