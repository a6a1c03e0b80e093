"""License scans: normalised text against licence templates, by the Dice coefficient of their sets of word bigrams.

Units of comparison are the whole text, each line, each sentence of a line, and the runs of consecutive sentences over
several lines. A unit's number of bigrams bounds the coefficient with a template from above, 2 min(a, b) / (a + b);
templates whose bound is under the threshold aren't compared, nor those of whose bigrams the text has too few for any
unit. Of the runs that match, the best are matches where no unit or run of at least their coefficient is of that licence
and overlaps, or of another licence and in about the same place.

Defined cases: null and empty texts have no units and match nothing; a unit of fewer than two words has no bigram and
coefficient 0; of equal coefficients the first template by name wins; rows are independent; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import spread
from quillon.llm.licence_texts import FULL

LEAST = 0.8
#: Public licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium is strictly prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: What follows the openings above in the complete short licences and notices.
REST = {
    "BSD-3-Clause": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0": 'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
    "GPL-3.0": 'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    "ISC": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": 'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
}
_NUMBERED = TEMPLATES["BSD-3-Clause"][1].replace("met: Redis", "met: 1. Redis").replace("disclaimer. Redis", "disclaimer. 2. Redis").replace("distribution. Neither", "distribution. 3. Neither")
#: The notices, and beside them the complete texts.
COMPLETE = {name: texts + [f"{texts[-1]} {rest}" for rest in [REST.get(name)] if rest] + [t for t in [FULL.get(name)] if t] for name, texts in TEMPLATES.items()}
COMPLETE["BSD-3-Clause"] = COMPLETE["BSD-3-Clause"] + [f"{_NUMBERED} {REST['BSD-3-Clause']}"]
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Matcher:
    def __init__(self, templates=None, least: float = LEAST):
        self.least = least
        sets = [(len(b), name, b) for name, texts in (templates or COMPLETE).items() for t in texts if (b := bigrams(normalised(t)))]
        self.templates = sorted(sets, key=lambda x: x[:2])
        self.ratio = least / (2 - least)
        self.known = set().union(*(b for _, _, b in self.templates))

    def live(self, words: list[str]) -> list[tuple[int, str, set]]:
        """Templates that a unit can match: it has at least t / (2 - t) of their bigrams."""
        hits = self.known.intersection(zip(words, words[1:], strict=False))
        return [t for t in self.templates if len(hits) >= t[0] * self.ratio - 1e-9 and len(hits & t[2]) >= t[0] * self.ratio - 1e-9]

    def best(self, found: set, templates=None) -> tuple[float, str | None]:
        """The best template within the size bounds: a coefficient of at least t needs sizes within t / (2 - t)."""
        n, out = len(found), (0.0, None)
        for size, name, b in self.templates if templates is None else templates:
            if n * self.ratio - 1e-9 <= size <= n / self.ratio + 1e-9:
                dice = 2 * len(found & b) / (n + size)
                if dice >= self.least and (dice > out[0] or dice == out[0] and name < out[1]):
                    out = dice, name
        return out

    def runs(self, pieces: list[tuple[int, int, list[str]]], templates, found: list) -> list[tuple[int, int, float, str]]:
        """The matches of runs of two pieces (start, end, words) or more that found has not got."""
        pieces = [p for p in pieces if p[2]]
        stop = np.cumsum([len(w) for _, _, w in pieces])
        start = stop - [len(w) for _, _, w in pieces]
        words, seen = [w for p in pieces for w in p[2]], {}
        pairs = list(zip(words, words[1:], strict=False))
        # the place of a bigram's previous occurrence: in a run it counts once, at its first
        before = np.full(len(pairs), -1)
        for i, p in enumerate(pairs):
            before[i] = seen.get(p, -1)
            seen[p] = i
        many = []
        for size, name, b in templates:
            known = np.fromiter((p in b for p in pairs), bool, len(pairs))
            hits = np.flatnonzero(known)
            most, taken = size / self.ratio, [(x, y) for x, y, dice, other in found if other == name and dice == 1]
            for k in np.unique(np.searchsorted(stop, hits, "right")).tolist():
                lo, width = int(start[k]), int(2 * most) + 64
                if any(x < pieces[k][1] and pieces[k][0] < y for x, y in taken):
                    continue
                while True:  # until the run has too many bigrams, or no further one of the template's
                    new = before[lo : lo + width] < lo
                    n = np.cumsum(new)
                    if n[-1] > most or lo + width > hits[-1]:
                        break
                    width *= 2
                ends = stop[k + 1 : np.searchsorted(stop, lo + len(n) + 1, "right")]
                if not len(ends):
                    continue
                at = ends - lo - 2
                dice = 2 * np.cumsum(new & known[lo : lo + width])[at] / (n[at] + size)
                q = int(dice.argmax())
                if dice[q] >= self.least:
                    many.append((pieces[k][0], pieces[k + 1 + q][1], float(dice[q]), name))
        out = list(found)
        for a, b, dice, name in sorted(many, key=lambda x: (-x[2], x[3], x[0], -x[1])):
            if not any((common := min(b, y) - max(a, x)) > 0 and least >= dice and (other == name or 2 * common > max(b, y) - min(a, x)) for x, y, least, other in out):
                out.append((a, b, dice, name))
        return out[len(found) :]

    def scan(self, text: str | None) -> list[tuple[int, int, float, str]]:
        """Matches (start, end, coefficient, licence) of the text's units in order; offsets are code points."""
        text = text or ""
        words = normalised(text)
        live = self.live(words)
        if not live:
            return []
        units, pieces, at = {(0, len(text))}, [], 0
        for line in text.split("\n"):
            units.add((at, at + len(line)))
            start = at
            for m in _SENTENCE.finditer(line):
                pieces.append((start, at + m.start()))
                start = at + m.end()
            pieces.append((start, at + len(line)))
            at += len(line) + 1
        out = []
        for a, b in sorted(units.union(pieces)):
            dice, name = self.best(bigrams(normalised(text[a:b])), live)
            if name:
                out.append((a, b, dice, name))
        return sorted(out + self.runs([(a, b, normalised(text[a:b])) for a, b in pieces], live, out))


def scan(docs: DataFrame, templates=None, least: float = LEAST) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_matches, license and dice of the best match, spans (start:end:licence, ...)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        matcher = Matcher(templates, least)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = matcher.scan(text.as_py())
                best = min(found, key=lambda x: (-x[2], x[3]), default=(0, 0, 0.0, None))
                rows.append((len(found), best[3], best[2], ",".join(f"{a}:{b}:{name}" for a, b, _, name in found)))
            n, name, dice, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "n_matches", "license", "dice", "spans"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_matches long, license string, dice double, spans string")


def query(spark, docs: DataFrame) -> DataFrame:
    return scan(docs)
