"""License texts and notices in documents: winnowed fingerprints, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Words of a fingerprint, neighbouring fingerprints of which the least is kept: every
#: run of GRAM + WINDOW - 1 = 4 equal words shares a kept fingerprint.
GRAM, WINDOW = 3, 2
#: Alignment: width of the band on either side, least share of the template's words.
BAND, COVERAGE = 8, 0.8
MATCH, MISS, GAP = 2, -1, -1
#: One fingerprint in the band for this many words of the template, at least one, asks for an
#: alignment: a match of COVERAGE has one for every fifth word even if its gaps are spread evenly.
SHARE = 6
#: Templates below this many words must be there word for word: any of them may name the license.
SHORT = 12
CACHED_WORDS = 400_000
WORD = re.compile(r"[a-z0-9]+")

# Public license texts and notices.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY "
        "THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License "
        "for more details."),
    "CC0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty."),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "GPL notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC0 notice": "Licensed under CC0 1.0.",
    "BSD notice": "Released under the BSD License.",
    "BSD notice, licensed": "Licensed under the BSD License.",
    "ISC notice": "Licensed under the ISC License.",
    "LGPL notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
}
# End of the fixed values.


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def fingerprints(words: list[str], hashes: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) kept by winnowing; a text of fewer words than a fingerprint has none."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for k in range(GRAM):
        total = mix64(total * np.uint64(3) + h[k:n + k])
    keep = np.zeros(n, np.bool_)
    if n < WINDOW:
        keep[total.argmin()] = True
    for start in range(WINDOW if n >= WINDOW else 0):
        rows = np.arange(start, n - WINDOW + 1, WINDOW)
        if len(rows):
            windows = total[rows[:, None] + np.arange(WINDOW)]
            keep[rows + WINDOW - 1 - windows[:, ::-1].argmin(axis=1)] = True
    place = np.flatnonzero(keep)
    return total[place], place


class Index:
    """Fingerprints of the templates -> (template, place); a constant of the code, so its size is fixed."""

    def __init__(self, templates: dict[str, str], hashes: _WordHashes):
        self.names = list(templates)
        self.words = [WORD.findall(t.lower()) for t in templates.values()]
        found = [(h, k, p) for k, words in enumerate(self.words) for h, p in zip(*(x.tolist() for x in fingerprints(words, hashes)))]
        self.table: dict[int, list[tuple[int, int]]] = {}
        for h, k, p in found:
            self.table.setdefault(h, []).append((k, p))
        self.sorted = np.array(sorted(self.table), np.uint64)

    def hits(self, prints: np.ndarray, places: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """template -> [(place in the text, place in the template)], in the order of the text."""
        at = np.minimum(np.searchsorted(self.sorted, prints), len(self.sorted) - 1)
        out: dict[int, list[tuple[int, int]]] = {}
        for h, place in zip(prints[self.sorted[at] == prints].tolist(), places[self.sorted[at] == prints].tolist()):
            for template, there in self.table[h]:
                out.setdefault(template, []).append((place, there))
        return out


def align(text: list[str], template: list[str], shift: int) -> tuple[int, int, int]:
    """(words that match, first place, place after the last) of the best local alignment
    whose places differ from ``shift`` by at most BAND."""
    width = 2 * BAND + 1
    above = [(0, 0, 0, 0)] * width  # score, matches, begin, end by offset in the band
    best = (0, 0, 0, 0)
    for row, word in enumerate(template):
        line: list[tuple[int, int, int, int]] = []
        for cell in range(width):
            place = row + shift + cell - BAND
            if not 0 <= place < len(text):
                line.append((0, 0, place, place))
                continue
            score, matches, begin, end = above[cell]
            if text[place] == word:
                new = (score + MATCH, matches + 1, begin if score > 0 else place, place + 1)
            else:
                new = (score + MISS, matches, begin, end)
            if cell + 1 < width and above[cell + 1][0] + GAP > new[0]:
                new = (above[cell + 1][0] + GAP, *above[cell + 1][1:])
            if cell and line[-1][0] + GAP > new[0]:
                new = (line[-1][0] + GAP, *line[-1][1:])
            line.append(new if new[0] > 0 else (0, 0, place, place))
            if new[0] > best[0]:
                best = new
        above = line
    return best[1], best[2], best[3]


def scan(text: str, index: Index, hashes: _WordHashes, coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, words that match, begin, end in code points); where spans
    overlap, the one with more matching words stays."""
    lower = text.lower()
    words = WORD.findall(lower)
    found = []
    for template, places in index.hits(*fingerprints(words, hashes)).items():
        wanted = index.words[template]
        done = -1
        for place, there in places:
            shift = place - there
            if place < done or sum(abs(p - t - shift) <= BAND for p, t in places) < len(wanted) // SHARE:
                continue
            matches, begin, end = align(words, wanted, shift)
            whole = len(wanted) >= SHORT or matches == len(wanted) == end - begin
            if matches >= coverage * len(wanted) and whole:
                found.append((-matches, begin, end, template))
                done = end
    if not found:
        return []
    offsets = [(m.start(), m.end()) for m in WORD.finditer(lower)]
    if len(lower) != len(text):  # lower-casing may lengthen a text; count in the text itself
        offsets = _offsets(text)
    out, taken = [], []
    for matches, begin, end, template in sorted(found):
        if all(end <= b or begin >= e for b, e in taken):
            taken.append((begin, end))
            out.append((index.names[template], -matches / len(index.words[template]), -matches, offsets[begin][0], offsets[end - 1][1]))
    return sorted(out, key=lambda r: r[3])


def _offsets(text: str) -> list[tuple[int, int]]:
    """Begin and end of each word in the text itself, where lower-casing moved them."""
    lower, back = [], []
    for k, c in enumerate(text):
        low = c.lower()
        lower.append(low)
        back += [k] * len(low)
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer("".join(lower))]


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each license or notice found in a whole text: doc_id, license,
    coverage (share of the template's words), n_matched, span_begin, span_end (code
    points) and the passage.

    Null and empty texts have none; repeated rows report each; an empty table gives
    no rows; extra columns are ignored.
    """
    wanted = templates or TEMPLATES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        index = Index(wanted, hashes)
        for batch in batches:
            rows = [(doc, *match, text[match[3]:match[4]]) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if text for match in scan(text, index, hashes, coverage)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [
                    "doc_id", "license", "coverage", "n_matched", "span_begin", "span_end", "passage"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        read, "doc_id long, license string, coverage double, n_matched long, span_begin long, span_end long, passage string")
