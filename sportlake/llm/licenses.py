"""Licence scan by conditional compression.

Blocks of words around telling words of licence notices are the candidates; they reach as far as the longest template on both sides, so a notice with a
telling word lies whole in its block (one whose telling words are all changed is no candidate). Each is compressed alone and with every template as a
zstandard raw dictionary; what a template saves ranks the templates, and for each that saves some share of what it
takes itself, and for each short one, the exact wording differences decide: the fewest words of the template that are missing and words added inside, by an
alignment of the whole template. Of templates in one place the one stays that has most words the same, less those that differ. Templates may leave words open (a year, a name). So few differences as are allowed leave a run of
template words unchanged, so only places with such a run are aligned, each within the reach of the template; the time for a block
grows with its length.

Nulls, ties and odd rows: null and empty texts have no block. Templates that fit equally well rank by their savings, then by their names.
Repeated rows get rows each; an empty table gives no rows. Whole texts are read, and every block of them. Further columns of docs,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import documents, mapped

# The wording of public licence notices; <> stands for words left open.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "copyright": "Copyright (c) <>",
    "all-rights-reserved": "All rights reserved.",
}
TELLING = r"(?i)licen[cs]e|copyright|permission|redistribut|rights\s+reserved|free\s+software|warrant(?:y|ies)|liable|misrepresented"
_TELLING = re.compile(TELLING)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Words of a block that are compressed at once; a longer block goes in stretches that overlap by the reach of the templates.
STRETCH = 4096
LEAST_GAIN = 0.05
#: So few words may save nothing beside what the rest of a long block saves already; such templates are always held against the wording.
SHORT = 16
#: Share of the template's words that may be missing or added.
DIFFERENT = 0.15


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case, with their place in the text."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def placed(block: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Places where the wanted words stand with few differences, from left to right and not overlapping: first and end word, missing and added words.

    Words are numbers. Of the alignments within reach of a run that both share, the one with the fewest differences counts, of
    several the one that ends first and of these the shortest.
    """
    n = len(wanted)
    most = int(DIFFERENT * n)
    run = -(-(n - most) // (most + 1))  # so few differences leave a run of so many words
    if len(block) < run:
        return
    spread = np.array([pow(1_000_003, k, 1 << 61) for k in range(run)], np.int64)
    grams = [np.lib.stride_tricks.sliding_window_view(x, run) @ spread for x in (block, wanted)]
    where: dict[int, list[int]] = {}
    for a, g in enumerate(grams[1].tolist()):
        where.setdefault(g, []).append(a)
    used, tried = 0, {}  # tried: by the difference of places, the end of the last run there
    for b in np.flatnonzero(np.isin(grams[0], grams[1])).tolist():
        for a in where[int(grams[0][b])]:
            if b < used or tried.get(b - a, -1) >= b:
                continue
            size = run
            while b + size < len(block) and a + size < n and block[b + size] == wanted[a + size]:
                size += 1
            tried[b - a] = b + size - run
            low, high = max(used, b - a - most), min(len(block), b - a + n + most)
            cost, start, end = aligned(block[low:high], wanted)
            if cost <= most:
                same = (n + end - start - cost) // 2
                yield low + start, low + end, n - same, end - start - same
                used = low + end


def aligned(block: np.ndarray, wanted: np.ndarray) -> tuple[int, int, int]:
    """Fewest missing and added words of wanted anywhere in the block, and where it then stands."""
    size = len(block) + 1
    step = size * np.arange(size)
    best = np.arange(size)[::-1].copy()  # differences times size, and the start from the right, for each end
    for word in wanted:
        kept = np.full(size, np.iinfo(np.int64).max // 2)
        kept[1:] = np.where(block == word, best[:-1], kept[1:])
        best = np.minimum.accumulate(np.minimum(best + size, kept) - step) + step
    end = int((best // size).argmin())
    return int(best[end] // size), size - 1 - int(best[end] % size), end


class Templates:
    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.items, self.numbers = [], {}
        for name, text in sorted(templates.items()):
            words = [w for w, _, _ in words_of(text.replace("<>", " "))]
            body = " ".join(words).encode()
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            wanted = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
            self.items.append((name, wanted, zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False), max(1, len(self.alone.compress(body)))))
        #: Words that a copy of any template takes at most, so that it lies whole within so many words of each of its own.
        self.reach = max((len(w) + int(DIFFERENT * len(w)) for _, w, _, _ in self.items), default=0)

    def saved(self, plain: list[str]) -> list[int]:
        """Bytes that each template saves, at most, in a stretch of the words."""
        best = [-(1 << 62)] * len(self.items)
        for a in range(0, max(1, len(plain) - self.reach), STRETCH):
            body = " ".join(plain[a : a + STRETCH + self.reach]).encode("utf-8", "surrogatepass")
            size = len(self.alone.compress(body))
            best = [max(b, size - len(c.compress(body))) for b, (_, _, c, _) in zip(best, self.items, strict=True)]
        return best

    def found(self, words: list[tuple[str, int, int]]) -> list[tuple]:
        """name, start, end, gain, missing, added of each confirmed template in a block."""
        plain = [w for w, _, _ in words]
        numbers = np.array([self.numbers.get(w, 0) for w in plain], np.int64)
        saved = [(gain, own, name, wanted) for gain, (name, wanted, _, own) in zip(self.saved(plain), self.items, strict=True)]
        held = []
        for gain, own, name, wanted in sorted(saved, key=lambda g: (-g[0], g[2])):
            if gain >= LEAST_GAIN * own or len(wanted) <= SHORT:
                for a, b, missing, added in placed(numbers, wanted):
                    held.append((a, b, len(wanted) - 2 * missing - added, len(held), name, gain / own, missing, added))
        out, taken = [], []
        for a, b, _, _, *found in sorted(held, key=lambda x: (-x[2], x[3])):  # words that are the same over words that differ, then savings
            if not any(a < d and c < b for c, d in taken):
                taken.append((a, b))
                name, gain, missing, added = found
                out.append((name, words[a][1], words[b - 1][2], gain, missing, added))
        return out


def blocks(words: list[tuple[str, int, int]], text: str, reach: int) -> list[tuple[int, int]]:
    """Ranges of so many words before and after telling words; those that touch are one."""
    places = [m.start() for m in _TELLING.finditer(text)]
    if not places:
        return []
    out: list[list[int]] = []
    k = 0
    for p in places:
        while k < len(words) and words[k][2] <= p:
            k += 1
        a, b = max(0, k - reach), min(len(words), k + reach + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(templates: dict[str, str]):
    names = ["doc_id", "block", "license", "start", "end", "gain", "n_missing", "n_added"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for k, (a, b) in enumerate(blocks(words, text, known.reach)):
                    rows += [(doc_id, k, *x) for x in known.found(words[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    return run


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, block, license, start, end (characters), gain, n_missing, n_added of every notice found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(TELLING))
    return mapped(rows, _scan(templates or TEMPLATES), "doc_id long, block int, license string, start long, end long, gain double, n_missing int, n_added int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(documents(spark, sf_dir))
