"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment reports coverage and spans.

A template's fingerprints are the least hashes of its word k-grams in sliding windows, by position. A document's k-grams are looked up at every
place, so each fingerprint that it shares is met; places on nearby diagonals make a candidate region. Places with enough of a template's words
are candidates as well, as a changed notice may share no fingerprint. There the template's words are
aligned with the document's in a band around the diagonals, which allows words to be changed, left out or added. Regions that don't hold enough of the
template's words, each counted as often as the template has it at most, are left before alignment.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import map_batches, texts
from lodestream.llm.decontam import WORD_BYTES

GRAM, WINDOW = 3, 3
#: Share of a template's words that must be matched, and how far (words, share of the template) alignments leave their diagonals.
COVERAGE, BAND, BAND_SHARE = 0.8, 4, 0.15
#: Templates of so many words at most are aligned from every place on; longer ones in steps of their band.
SHORT = 40
#: Words of a template that are looked for together before an alignment.
BLOCK = 64
WORD = re.compile(rb"[^ ]+")

#: The customary notices, as their licenses ask for them or as projects put them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    'permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
    '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}

#: Whole licenses, a file each.
TEMPLATES |= {path.stem: path.read_text() for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def words(text: bytes) -> list[bytes]:
    """Letters and digits as in decontamination: ASCII as lower case, every character beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the least hash of each window (the last of equal ones); of all, if they don't fill one."""
    if len(hashes) <= window:
        return [max(range(len(hashes)), key=lambda i: (-hashes[i], i))] if hashes else []
    return sorted({max(range(a, a + window), key=lambda i: (-hashes[i], i)) for a in range(len(hashes) - window + 1)})


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.number: dict[bytes, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(templates[x].encode())], np.int64) for x in self.names]
        self.base = len(self.number) + 1
        postings = []
        for t, (name, ids) in enumerate(zip(self.names, self.words, strict=True)):
            spelled = words(templates[name].encode())
            size = min(GRAM, len(ids))
            hashes = [xxhash.xxh64_intdigest(b" ".join(spelled[i : i + size])) for i in range(len(ids) - size + 1)]
            postings += [(self._code(ids[i : i + size]), t, i) for i in winnow(hashes)] if size == GRAM else []
        self.bag = np.zeros((len(self.names), self.base), np.int32)  # how often each template has each word
        for t, ids in enumerate(self.words):
            np.add.at(self.bag[t], ids, 1)
        self.enough = np.array([max(1, int(np.ceil(COVERAGE * len(w) - 1e-9))) for w in self.words])
        self.blocks = [[np.unique(ids[a : a + BLOCK], return_counts=True) for a in range(0, len(ids), BLOCK)] for ids in self.words]
        postings.sort()
        self.code, self.template, self.offset = (np.array(x, np.int64) for x in zip(*postings, strict=True))

    def _code(self, ids: np.ndarray) -> int:
        code = 0
        for x in ids:
            code = code * self.base + int(x)
        return code

    def numbers(self, found: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in found], np.int64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first and last diagonal) of regions to align: a diagonal is the document's place less the template's."""
        n = len(ids) - GRAM + 1
        if n <= 0:
            return []
        at = np.flatnonzero((ids[:n] > 0) & (ids[1 : n + 1] > 0) & (ids[2 : n + 2] > 0))
        code = (ids[at] * self.base + ids[at + 1]) * self.base + ids[at + 2]
        first, last = np.searchsorted(self.code, code), np.searchsorted(self.code, code, side="right")
        hits = [(int(self.template[p]), int(a) - int(self.offset[p])) for a, f, z in zip(at[last > first], first[last > first], last[last > first], strict=True) for p in range(f, z)]
        regions: list[tuple[int, int, int]] = []
        for t, d in sorted(set(hits)):
            if regions and regions[-1][0] == t and d - regions[-1][1] <= self.band(t):
                regions[-1] = (t, regions[-1][1], d)
            else:
                regions.append((t, d, d))
        return regions

    def dense(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """Regions as of candidates() that no alignment of COVERAGE within 2 * band diagonals escapes, whether or not it shares a fingerprint.

        Such an alignment lies in the template's length and 2 * band words from its lowest diagonal on, so these hold enough of the template's words.
        """
        found = []
        known, often = np.unique(ids[ids > 0], return_counts=True)
        possible = np.flatnonzero(np.minimum(self.bag[:, known], often).sum(axis=1) >= self.enough)
        places = Places(ids) if len(possible) else None
        for t in possible.tolist():
            n, band = len(self.words[t]), self.band(t)
            size = n + 2 * band
            held = np.concatenate((np.zeros(size + 1, np.int64), np.cumsum(self.bag[t][ids] > 0)))
            held = np.concatenate((held, np.full(size, held[-1])))
            starts = np.flatnonzero(held[size:] - held[:-size] >= self.enough[t]) - size
            starts = starts[self._held(places, t, starts, starts + size) >= self.enough[t]]
            step, at = 1 if n <= SHORT else band, 0
            while at < len(starts):
                end = int(np.searchsorted(starts, starts[at] + step))
                found.append((t, int(starts[at]) + band, int(starts[end - 1]) + band))
                at = end
        return found

    def _held(self, places: Places, t: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words of template ``t`` in each window of places, each as often as the template has it at most."""
        total = np.zeros(len(starts), np.int64)
        for w in np.flatnonzero(self.bag[t]) if len(starts) else ():
            at = places.of(w)
            if len(at):
                total += np.minimum(np.searchsorted(at, ends) - np.searchsorted(at, starts), self.bag[t, w])
        return total

    def _in_reach(self, t: int, ids: np.ndarray, low: int, high: int) -> bool:
        """Whether diagonals low to high may hold enough words of template ``t``: those of each of its blocks must lie where the diagonals lead them, each word as
        often there. No alignment has more, and words in another order mostly have far less, for a small part of an alignment's cost."""
        most, a = len(self.words[t]), 0
        for block, counts in self.blocks[t]:
            size = int(counts.sum())
            there = np.bincount(ids[max(0, a + low) : max(0, a + size + high)], minlength=self.base)
            most -= size - int(np.minimum(there[block], counts).sum())
            if most < self.enough[t]:
                return False
            a += size
        return True

    def band(self, t: int) -> int:
        return BAND + int(len(self.words[t]) * BAND_SHARE)

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int, int, int]]:
        """(template, coverage, matched words, first and last word, first and last byte of the whole text) of each match, in order of place.

        Of matches that share words the one with the most matched words stays, then the one with more coverage, then the first by name.
        """
        spaced = text.translate(WORD_BYTES)
        ids = self.numbers(spaced.split())
        found = []
        for t, low, high in sorted({*self.candidates(ids), *self.dense(ids)}):
            low, high, n = low - self.band(t), high + self.band(t), len(self.words[t])
            rest = [(max(0, low), min(len(ids), high + n))]
            while rest:  # a region may hold several matches: what lies before and behind one is looked at as well
                start, end = rest.pop()
                if np.minimum(np.bincount(ids[start:end], minlength=self.base), self.bag[t]).sum() < self.enough[t]:
                    continue
                if not self._in_reach(t, ids[start:end], low - start, high - start):
                    continue
                matched, a, b = align(self.words[t], ids[start:end], low - start, high - start, int(self.enough[t]))
                if matched >= self.enough[t]:
                    a, b = a + start, b + start
                    found.append((matched, matched / n, self.names[t], a, b))
                    rest += [(start, a), (b + 1, end)]
        kept: list[tuple] = []
        for m in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3])):
            if all(m[4] < k[3] or m[3] > k[4] for k in kept):
                kept.append(m)
        if not kept:
            return []
        spans = [w.span() for w in WORD.finditer(spaced)]
        return [(name, coverage, matched, a, b, spans[a][0], spans[b][1]) for matched, coverage, name, a, b in sorted(kept, key=lambda m: m[3])]


class Places:
    """Where each word of a document stands."""

    def __init__(self, ids: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]

    def of(self, word: int) -> np.ndarray:
        a, b = np.searchsorted(self.sorted, (word, word + 1))
        return self.order[a:b]


def align(template: np.ndarray, ids: np.ndarray, low: int, high: int, enough: int = 0) -> tuple[int, int, int]:
    """Most words of ``template`` that match the document in order within diagonals low to high, and the first and last word of the shortest such match.

    A band of high - low + 1 cells for each template word, a row at once. A cell has matched words and, of as many, the latest first word as one number;
    cell j of row i is the best that ends at place i + low + j of the document or before. Once the rows left can't make ``enough`` words any more, it is given up:
    then the words matched are fewer than that.
    """
    n, width = len(ids), high - low + 1
    one = n + 1
    best = np.zeros(width + 1, np.int64)
    result, rank = (0, 0, 0), (0, 0)
    for i, w in enumerate(template.tolist()):
        # a template word left out: the same place in the row above lies one cell to the right, the place before it straight above
        row = np.maximum(best[:-1], best[1:])
        first = max(0, -(i + low))
        at = first + np.flatnonzero(ids[i + low + first : max(0, i + low + width)] == w)
        if len(at):
            place, before = at + i + low, best[at]
            cell = np.where(before >= one, before + one, one + place)
            row[at] = np.maximum(row[at], cell)
            matched, begin = cell // one, cell % one
            top = int(np.lexsort((begin - place, matched))[-1])
            this = (int(matched[top]), int(begin[top] - place[top]))
            if this > rank or not result[0]:
                rank, result = this, (int(matched[top]), int(begin[top]), int(place[top]))
        best[:-1] = np.maximum.accumulate(row)  # a document word passed over
        if i % 16 == 15 and int(best[-2]) // one + len(template) - 1 - i < enough:
            break
    return result


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match in a row of ``docs``: id, match_no, license, coverage, n_matched, first_word, last_word, first_byte, end_byte.

    Matches of a text don't overlap and count from 0 by place. Null and empty texts have none; repeated rows have theirs each; an empty table gives no row; other
    columns are ignored. Templates are a dictionary of the driver's and go along with the code; each needs GRAM words at least.
    """
    templates = TEMPLATES if templates is None else templates
    short = [x for x, t in templates.items() if len(words(t.encode())) < GRAM]
    if short:
        raise ValueError(f"templates of fewer than {GRAM} words: {short}")
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    names = ["id", "match_no", "license", "coverage", "n_matched", "first_word", "last_word", "first_byte", "end_byte"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        rows = [(i, k, *m) for i, text in zip(part.column("id").to_pylist(), texts(part.column("text")), strict=True) for k, m in enumerate(index.scan(text))]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "id long, match_no int, license string, coverage double, n_matched long, first_word long, last_word long, first_byte long, end_byte long"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", schema, work)
