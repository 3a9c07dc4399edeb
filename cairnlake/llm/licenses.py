"""License scans by patience alignment.

Words that are unique both to a stretch of text and to a template are anchors; the longest
increasing subsequence of their places is kept, and the gaps between anchors are aligned the same
way, down to equal words at the gaps' ends. The share of a template's words that align
is its coverage.

Stretches lie where an occurrence of the template's words that are rarest in the text says that a copy may start. With
coverage c at least, so few template words are missing that one of the rarest must be
among those that align, so that no copy is overlooked. Copies of one template may stand side by side: each is a hit of its own.

Defined results: null and empty texts hold no license; repeated rows are scanned row by row; of
equal coverage the longer template comes first, then by name, then by place; very long texts are scanned whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnlake.llm.common import slices

MIN_COVERAGE = 0.8
#: Words between two aligned words, at most, for them to be of one occurrence.
MAX_GAP = 8
#: A gap in which no word is unique is aligned word by word if it has so many pairs of places at most.
GAP_CELLS = 4096

# Notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "WTFPL-text": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
}

_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both, by patience; small gaps that hold no anchor are aligned word by word."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        anchors = _longest_rising(_unique_to_both(a, i, j, b, k, m))
        if not anchors:
            if (j - i) * (m - k) <= GAP_CELLS:
                out += _common(a, i, j, b, k, m, last=j < len(a))
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def _common(a: list[str], i: int, j: int, b: list[str], k: int, m: int, *, last: bool) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of a small gap without anchors; of several, the ``last`` or the first in ``a``."""
    if last:
        x, y = a[i:j][::-1], b[k:m][::-1]
        return [(j - 1 - p, m - 1 - q) for p, q in _common(x, 0, len(x), y, 0, len(y), last=False)]
    most = [[0] * (m - k + 1) for _ in range(j - i + 1)]
    for p in range(j - i - 1, -1, -1):
        for q in range(m - k - 1, -1, -1):
            most[p][q] = most[p + 1][q + 1] + 1 if a[i + p] == b[k + q] else max(most[p + 1][q], most[p][q + 1])
    out, p, q = [], 0, 0
    while p < j - i and q < m - k and most[p][q]:
        if a[i + p] == b[k + q]:
            out.append((i + p, k + q))
            p, q = p + 1, q + 1
        elif most[p][q + 1] >= most[p + 1][q]:
            q += 1
        else:
            p += 1
    return out


def _unique_to_both(a, i, j, b, k, m) -> list[tuple[int, int]]:
    def once(x, lo, hi):
        at: dict[str, int] = {}
        for p in range(lo, hi):
            at[x[p]] = -1 if x[p] in at else p
        return at

    of_b = once(b, k, m)
    return [(p, of_b[w]) for w, p in once(a, i, j).items() if p >= 0 and of_b.get(w, -1) >= 0]


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, in order of the first place, whose second places rise."""
    pairs = sorted(pairs)
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(ends, y)
        before.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(y)
            last.append(n)
        else:
            ends[k], last[k] = y, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _coverage(found: list[str], i: int, j: int, t: list[str], need: int, *, tight: bool = True) -> tuple[int, int, int] | None:
    """(aligned words, first, last) of the best run without large gaps in found[i:j], if it has ``need`` words.

    A ``tight`` run leaves out ends that skip more than two words of the text for each word they add, which as
    likely are of a copy beside it.
    """
    runs: list[list[tuple[int, int]]] = []
    for pair in align(found[i:j], t):
        if runs and pair[0] - runs[-1][-1][0] <= MAX_GAP + 1:
            runs[-1].append(pair)
        else:
            runs.append([pair])
    best = max(runs, key=len, default=[])
    if len(best) < need:
        return None
    if tight:
        top, sum_, start, cut = 0.0, 0.0, 0, (0, len(best))
        for k, (p, _) in enumerate(best):
            sum_ -= (p - best[k - 1][0] - 1) / 2 if k else 0
            if sum_ < 0:
                sum_, start = 0.0, k
            sum_ += 1
            if sum_ > top:
                top, cut = sum_, (start, k + 1)
        if cut[1] - cut[0] >= need:
            best = best[slice(*cut)]
    return len(best), i + best[0][0], i + best[-1][0]


def _starts(t: list[str], places: dict[str, list[int]], spare: int) -> list[int]:
    """Where a copy may start, rising: from every place of the words of the template that are rarest in the text.

    Words are taken until they are more words of the template than may be missing, so that one of them aligns in every copy.
    """
    at: dict[str, list[int]] = {}
    for q, w in enumerate(t):
        at.setdefault(w, []).append(q)
    out: set[int] = set()
    for w in sorted(at, key=lambda w: (len(places.get(w, ())) * len(at[w]), w)):
        out.update(p - q for p in places.get(w, ()) for q in at[w])
        spare -= len(at[w])
        if spare <= 0:
            break
    return sorted(out)


def _occurrences(found: list[str], places: dict[str, list[int]], t: list[str], least: float) -> list[tuple[int, int, int]]:
    """(aligned words, first, last) of each copy of the template, in order of place; copies do not overlap.

    Every candidate start is aligned in a stretch of the template's length, in which words of a
    neighbouring copy cannot hide anchors; what is not found there is tried in stretches that
    grow on both sides, for words that were added or left out, up to all that such changes can shift. Within one width better coverage goes first,
    so that a whole copy is never cut by a broken one beside it.
    """
    need = ceil(least * len(t) - 1e-9)
    starts = _starts(t, places, len(t) - need + 1)
    known = set(t)
    inside = [0]
    for w in found:
        inside.append(inside[-1] + (w in known))
    hits: list[tuple[int, int, int]] = []  # first, last, aligned; rising
    widest, grow = MAX_GAP * (len(t) - 1) + len(t), 0
    while True:
        tried: list[tuple[int, int, int]] = []
        before: tuple[int, int] | None = None
        step = grow // 4  # starts so near the last one are within its stretch
        last = -1 - len(t) - step
        for s in starts:
            if step and s - last <= step:
                continue
            i, j = max(0, s - grow), min(len(found), s + len(t) + grow + step)
            k = bisect_left(hits, (s + 1,)) - 1  # the last copy that starts at or before s
            i = max(i, hits[k][1] + 1) if k >= 0 else i
            j = min(j, hits[k + 1][0]) if k + 1 < len(hits) else j
            if j - i < need or (i, j) == before or inside[j] - inside[i] < need:
                continue
            before, last = (i, j), s
            if (got := _coverage(found, i, j, t, need)) and got not in tried:
                tried.append(got)
        ends: list[tuple[int, int, int]] = []
        for n, a, b in sorted(tried, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            k = bisect_left(ends, (b + 1,))
            if not (k and ends[k - 1][1] >= a):
                ends.insert(k, (a, b, n))
        hits = sorted([*hits, *ends])
        if ends:
            continue  # what is left beside the new copies, at the same width
        if grow >= widest:
            break
        grow = min(widest, max(2, 2 * grow))
    out = []
    for k, (a, b, n) in enumerate(hits):  # words beside a copy that its stretch had not reached
        low = max(0, a - MAX_GAP * 2, out[-1][2] + 1 if k else 0)
        high = min(len(found), b + 1 + MAX_GAP * 2, hits[k + 1][0] if k + 1 < len(hits) else len(found))
        more = _coverage(found, low, high, t, need, tight=False) if n < len(t) else None
        out.append(more if more and more[0] > n and more[1] <= b and more[2] >= a else (n, a, b))
    return out


def scan(found: list[str], templates: dict[str, list[str]], min_coverage: float = MIN_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word) of each occurrence, best first."""
    said = set(found)
    likely = {}
    for name, t in templates.items():
        kinds, spare = set(t), len(t) - ceil(min_coverage * len(t) - 1e-9)
        if t and len(kinds & said) >= len(kinds) - spare and sum(w in said for w in t) >= len(t) - spare:
            likely[name] = t
    if not likely:
        return []
    places: dict[str, list[int]] = {}
    every = set().union(*likely.values())
    for p, w in enumerate(found):
        if w in every:
            places.setdefault(w, []).append(p)
    hits = []
    for name, t in likely.items():
        hits += [(name, n / len(t), a, b) for n, a, b in _occurrences(found, places, t, min_coverage)]
    return sorted(hits, key=lambda h: (-h[1], -len(templates[h[0]]), h[0], h[2]))


def find(docs: DataFrame, templates: dict[str, str] | None = None, *, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_hits, hits) of each document; license is null if there is none."""
    known = {k: words(t) for k, t in (templates or TEMPLATES).items()}
    hit = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [scan(words(t), known, min_coverage) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([h[0][0] if h else None for h in got], pa.string()), pa.array([h[0][1] if h else 0.0 for h in got], pa.float64()), pa.array([len(h) for h in got], pa.int64()),
                 pa.array([[dict(zip(("license", "coverage", "first", "last"), x, strict=True)) for x in h] for h in got], pa.list_(hit))],
                ["doc_id", "license", "coverage", "n_hits", "hits"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, n_hits long, hits array<struct<license: string, coverage: double, first: int, last: int>>")
