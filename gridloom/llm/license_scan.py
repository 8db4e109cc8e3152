"""Licence scans: normalised passages against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.text import only

# Public licence notices and texts.
TEMPLATES = {
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License.""",
    "mit/notice": "Released under the MIT License.",
    "mit/licensed": "Licensed under the MIT License.",
    "mit/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "gpl-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0/header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by-4.0/notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0/notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense/text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that
recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE. For more information, please refer to https://unlicense.org""",
    "all-rights-reserved/notice": "All rights reserved.",
}
#: Least Dice coefficient of a hit.
LEAST_DICE = 0.8


_WORD = re.compile("[a-z0-9]+")


def normalised_words(text: str) -> list[str]:
    """Lower case, then runs of a-z and 0-9."""
    return _WORD.findall(text.lower())


def passages(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text, and where each line, each block of lines between lines without a word, and the whole text lie in them.

    A block of one line and a text of one block are not listed again.
    """
    every: list[str] = []
    lines, blocks, inside = [], [], False
    for line in text.split("\n"):
        if words := normalised_words(line):
            start = len(every)
            every += words
            lines.append((start, len(every)))
            first, n = (blocks.pop() if inside else (start, 0))
            blocks.append((first, n + 1))
            inside = True
        else:
            inside = False
    ends = [a for a, _ in blocks[1:]] + [len(every)]
    spans = lines + [(a, b) for (a, n), b in zip(blocks, ends) if n > 1]
    if len(blocks) > 1:
        spans.append((0, len(every)))
    return every, spans


class Templates:
    """Bigrams of the templates by size, and the words that they hold."""

    def __init__(self, texts: dict[str, str], least_dice: float):
        words = {name: normalised_words(text) for name, text in texts.items()}
        self.grams = {name: Counter(pairwise(w)) for name, w in words.items() if len(w) > 1}
        self.sizes = {name: sum(g.values()) for name, g in self.grams.items()}
        self.words = frozenset(w for name in self.grams for w in words[name])
        self.least_dice, self.ratio = least_dice, least_dice / (2 - least_dice)
        self.holders: dict[tuple[str, str], list[str]] = {}
        for name, grams in self.grams.items():
            for g in grams:
                self.holders.setdefault(g, []).append(name)
        self.low = self.ratio * min(self.sizes.values(), default=0)
        self.high = max(self.sizes.values(), default=-1) / self.ratio

    def hits(self, words: list[str]) -> Iterator[tuple[str, float]]:
        """Templates whose coefficient with a passage is high enough.

        The bigrams in common are at least ``ratio`` times the passage's own, so as many of its words are template words.
        """
        own = len(words) - 1
        if own < 1 or not self.low <= own <= self.high:
            return
        if sum(map(self.words.__contains__, words)) < self.ratio * own:
            return
        grams = Counter(pairwise(words))
        for name, size in self.sizes.items():
            if self.ratio * size <= own <= size / self.ratio:
                held = self.grams[name]
                both = sum(min(n, held[g]) for g, n in grams.items() if g in held)
                dice = 2.0 * both / (own + size)
                if dice >= self.least_dice:
                    yield name, dice


    def windows(self, words: list[str]) -> list[tuple[float, int, int, str]]:
        """``-dice, start, -end, template`` of the best window from each start, wherever windows start and end.

        Bigrams at the ends of a best window are the template's, and at least ``ratio`` times the template's bigrams lie in it, so only starts
        with so many of them within the largest size are followed.
        """
        places: dict[str, list[int]] = {}
        for at, gram in enumerate(pairwise(words)):
            for name in self.holders.get(gram, ()):
                places.setdefault(name, []).append(at)
        found = []
        for name, hits in places.items():
            size, held = self.sizes[name], self.grams[name]
            least, most = max(1, math.ceil(self.ratio * size - 1e-9)), size / self.ratio + 1e-9
            for i in range(len(hits) - least + 1):
                start = hits[i]
                if hits[i + least - 1] - start + 1 > most:
                    continue
                both, seen, best, end = 0, {}, 0.0, 0
                for j in range(i, len(hits)):
                    own = hits[j] - start + 1
                    if own > most:
                        break
                    gram = words[hits[j]], words[hits[j] + 1]
                    seen[gram] = n = seen.get(gram, 0) + 1
                    both += n <= held[gram]
                    if (dice := 2.0 * both / (own + size)) > best:
                        best, end = dice, hits[j] + 2
                if best >= self.least_dice:
                    found.append((-best, start, -end, name))
        return found

    def found(self, text: str) -> Iterator[tuple[str, float]]:
        """Template and coefficient of every passage that counts.

        Lines, blocks and the whole text come first, then windows outside those of the same template: of windows that overlap the best one, then the first. A passage of
        any kind whose bigrams in common with its template all belong to another one as well is that template's wording and left out, if it lies in a passage of that template which fits better, or as well and is longer. A line, block
        or text fits as well as the best window of its template inside it.
        """
        words, spans = passages(text)
        windows = self.windows(words)
        whole = [(-dice, a, -b, name) for a, b in spans for name, dice in self.hits(words[a:b])]
        starts: dict[str, list[tuple[int, int, float]]] = {}
        for low, a, end, name in windows if whole else ():
            starts.setdefault(name, []).append((a, -end, -low))  # in the order of their starts
        taken: dict[str, dict[int, list[tuple[int, float]]]] = {}
        used: dict[str, bytearray] = {}

        def foreign(a: int, b: int, dice: float, name: str) -> bool:
            grams = self.grams[name].keys() & set(pairwise(words[a:b]))
            for other in self.holders[min(grams, key=lambda g: len(self.holders[g]))]:
                if other == name or other not in taken or not grams <= self.grams[other].keys():
                    continue
                starts = taken[other]
                for x in range(a, max(-1, b - int(self.sizes[other] / self.ratio) - 3), -1):
                    if any(y >= b and (d > dice or d == dice and y - x > b - a) for y, d in starts.get(x, ())):
                        return True
            return False

        def fit(a: int, b: int, dice: float, name: str) -> float:
            inside = starts.get(name, [])
            for k in range(bisect_left(inside, (a,)), bisect_left(inside, (b,))):
                if inside[k][1] <= b:
                    dice = max(dice, inside[k][2])
            return dice

        def take(candidates: list[tuple[float, int, int, str]], once: bool) -> Iterator[tuple[str, float]]:
            for low, a, end, name in sorted(candidates):
                b, mine = -end, used.setdefault(name, bytearray(len(words)))
                if (once and any(mine[a:b])) or foreign(a, b, -low, name):
                    continue
                mine[a:b] = b"\1" * (b - a)
                taken.setdefault(name, {}).setdefault(a, []).append((b, -low if once else fit(a, b, -low, name)))
                yield name, -low

        yield from take(whole, False)
        yield from take(windows, True)


def license_scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    least_dice: float = LEAST_DICE,
) -> DataFrame:
    """``doc_id, template, passages, dice``: per row of ``docs`` and template, how many passages reach ``least_dice`` and the best coefficient.

    A passage is a line, a block of lines or the whole text, in lower case with everything but a-z and 0-9 as white space; beside these, any window of the text's
    words, inside a line or over several lines and blocks, where none of them reaches the template. A passage that is only the wording of a better fitting template is left out, so a notice
    gives the same rows alone on a line and inside a sentence (see ``Templates.found``). Dice is twice the
    bigrams in common, with their multiplicity, over the bigrams of both. A coefficient of at least d needs sizes whose ratio lies between d / (2 - d)
    and its inverse: passages outside the bounds of every template are passed over, and a passage meets only the templates inside its own bounds.
    The templates travel with the function, as the caller's list does not grow with the data. A narrow map: no shuffle.

    Null and empty texts, and passages of fewer than two words, match nothing. Two templates that reach the limit give two rows. Repeated rows
    are scanned each; null ids stay null. Very long texts are read once. An empty table, or an empty list of templates, gives an empty result; further columns are not
    read.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    known = Templates(TEMPLATES if templates is None else templates, least_dice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, counts, best = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found: dict[str, list[float]] = {}
                for name, dice in known.found(text or ""):
                    found.setdefault(name, []).append(dice)
                for name, values in sorted(found.items()):
                    at.append(i)
                    names.append(name)
                    counts.append(len(values))
                    best.append(max(values))
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(best, pa.float64())],
                names=["doc_id", "template", "passages", "dice"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, template string, passages long, dice double")
