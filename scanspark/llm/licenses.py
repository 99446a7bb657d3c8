"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a template are anchors; the longest run of anchors in the same order
in both is kept, and the gaps between them are aligned the same way. Coverage is the share of the template's words in place.
A stretch is three template lengths long and starts at every template length, so words are told apart within a place,
not within a document, and a license given twice is found. Stretches that hold too few of the template's words are left out
at once: their coverage cannot reach the limit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.llm.shared import batches

ENDS = ".,;:!?\"'()[]{}<>*#|-_/\\"

#: One-line notices in common use, license texts and the notices that licenses ask to be put into files (the words, without years and names).
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends; what has nothing else is no word."""
    return [w for w in (w.strip(ENDS) for w in text.lower().split()) if w]


def longest_increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence of distinct numbers, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of words aligned between a and b, ascending in both."""
    found: list[tuple[int, int]] = []
    open_: list[tuple[int, int, int, int]] = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if w in place]
        kept = [anchors[k] for k in longest_increasing([i for i, _ in anchors])]
        if not kept:
            continue
        found += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(found)


def scan(text: list[str], template: list[str], least: float, density: float) -> tuple[int, int, int] | None:
    """The best place of the template in the text: words in place, first and last word; None below least or too scattered.

    Words at the edges that lie apart from the others by more than the template's length are no part of the place.
    """
    m = len(template)
    vocabulary = set(template)
    best = None
    for start in range(0, max(1, len(text) - m + 1), m):
        part = text[start : start + 3 * m]
        if m - len(vocabulary.difference(part)) < least * m:
            continue
        places = patience(part, template)
        while places and places[-1][0] - places[0][0] + 1 > len(places) / density:
            # The end word that is further from its neighbour goes.
            if len(places) > 1 and places[1][0] - places[0][0] >= places[-1][0] - places[-2][0]:
                places.pop(0)
            else:
                places.pop()
        if len(places) >= least * m and (best is None or len(places) > best[0]):
            best = (len(places), start + places[0][0], start + places[-1][0])
    return best


def best_places(places: list[tuple]) -> list[tuple]:
    """Of (license, n_matched, n_words, first, last) those that don't lie, by half or more of the shorter, in a place of more words (of equals, of a higher share of its template)."""
    kept: list[tuple] = []
    for one in sorted(places, key=lambda p: (-p[1], p[2], p[0])):
        over = [min(one[4], k[4]) - max(one[3], k[3]) + 1 for k in kept]
        if all(2 * o < min(one[4] - one[3], k[4] - k[3]) + 1 for o, k in zip(over, kept, strict=True)):
            kept.append(one)
    return sorted(kept)


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75, density: float = 0.5) -> DataFrame:
    """doc_id, license, coverage, n_matched, first_word, last_word: one row for each row of docs (doc_id, text) and template it holds.

    Of several places of a template in a text that with the most words in place counts (then the first); where places of templates lie over one
    another, as with versions of one license, that with the most words in place counts (then the shorter template, then the first name). Texts are scanned whole. A place's words are at least `density` of
    the stretch that they span. Null, empty and other texts without a license give no row; repeated rows give theirs each. Templates without words
    are never found. The templates are a parameter that every task holds; texts stay where they are read.
    """
    wanted = {name: words_of(t) for name, t in (TEMPLATES if templates is None else templates).items()}
    wanted = {name: (t, set(t)) for name, t in wanted.items() if t}
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def found(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                words = words_of(text or "")
                held, places = set(words), []
                for name, (template, vocabulary) in wanted.items():
                    # Words in place are at most all words of the template less one for each word of its vocabulary that the text lacks.
                    if len(template) - len(vocabulary - held) < least * len(template):
                        continue
                    if place := scan(words, template, least, density):
                        places.append((name, place[0], len(template), *place[1:]))
                rows += [(doc, name, n / size, n, a, b) for name, n, size, a, b in best_places(places)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)

    ddl = "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(found, ddl)
