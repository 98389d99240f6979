"""Licence scan: normalised text against licence templates by Dice over word bigrams.

Units of a document are all runs of its words, over lines and within them; a matcher without
``within_lines`` widens them to whole lines. The best run for
a template begins and ends with bigrams of the template; with a and b distinct bigrams Dice is
at most 2 min(a, b) / (a + b), so b must lie between a t / (2 - t) and a (2 - t) / t. Templates
are found through an index of their bigrams, and a text is searched for those of which it has
at least a t / (2 - t) distinct bigrams.

Defined cases: null and empty texts have no licence; of equal scores the template listed first
wins, of equal runs the first in the text; repeated rows each get their row; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, as_bytes

THRESHOLD = 0.8
#: Fixed texts: licence notices and short licences, by SPDX-like name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
)


def normalise(data: bytes) -> list[bytes]:
    """Words in lower case without punctuation."""
    return data.translate(WORD_TABLE).split()


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(zip(words, words[1:], strict=False))


@dataclass(frozen=True)
class Match:
    template: int
    dice: float
    first_line: int
    last_line: int


class LicenseMatcher:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, within_lines: bool = False):
        self.within_lines = within_lines
        self.names = [n for n, _ in templates]
        self.grams = [bigrams(normalise(t.encode())) for _, t in templates]
        self.threshold = threshold
        self.index: dict[tuple[bytes, bytes], list[int]] = {}
        for k, grams in enumerate(self.grams):
            for g in grams:
                self.index.setdefault(g, []).append(k)
        self.bounds = [(len(g) * threshold / (2 - threshold) - 1e-9, len(g) * (2 - threshold) / threshold + 1e-9) for g in self.grams]

    def _runs(self, grams: list[tuple[bytes, bytes]], at: list[int], k: int) -> Iterator[tuple[float, int, int]]:
        """The best run for template k from each start: dice, first and last bigram; ``at``: where it has bigrams.

        A best run begins and ends with bigrams of the template, and the first one does not come
        again in it, for the run without it would be as good. So each start is followed until its
        bigram comes again or the run has too many distinct bigrams: at most (bigrams of the
        template) x (bigrams of the text) steps."""
        own, (low, high) = self.grams[k], self.bounds[k]
        for s in at:
            seen, shared, best = {grams[s]}, 1, None
            for e in range(s, at[-1] + 1):
                g = grams[e]
                if e > s:
                    if g in seen:
                        if g == grams[s]:
                            break
                        continue
                    seen.add(g)
                    if len(seen) > high:
                        break
                    if g not in own:
                        continue
                    shared += 1
                if shared >= low:
                    dice = 2 * shared / (len(seen) + len(own))
                    if dice >= self.threshold and (best is None or dice > best[0]):
                        best = dice, s, e
            if best:
                yield best

    def match(self, data: bytes) -> Match | None:
        """The best match of any run, or None."""
        index, words = self.index, normalise(data)
        grams = list(zip(words, words[1:], strict=False))
        traces: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            if g in index:
                for k in index[g]:
                    traces.setdefault(k, []).append(i)
        found, ends = [], None
        for k, at in traces.items():
            low = self.bounds[k][0]
            if len(at) < low or len({grams[i] for i in at}) < low:
                continue
            for dice, s, e in self._runs(grams, at, k):
                ends = ends or list(accumulate(len(normalise(x)) for x in data.split(b"\n")))  # words up to the end of each line
                first, last = bisect_right(ends, s), bisect_right(ends, e + 1)
                if not self.within_lines:
                    unit = bigrams(words[ends[first - 1] if first else 0 : ends[last]])
                    dice = 2 * len(unit & self.grams[k]) / (len(unit) + len(self.grams[k]))
                if dice >= self.threshold:
                    found.append(Match(k, dice, first, last))
                if dice == 1.0:  # what starts later is no better and not before it
                    break
        return min(found, key=lambda m: (-m.dice, m.template, m.first_line, m.last_line), default=None)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (null if none), dice, first_line, last_line (from 0) for every row."""
    matcher = docs.sparkSession.sparkContext.broadcast(LicenseMatcher(templates, threshold, within_lines=True))  # its size depends on the templates only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher.value
        for batch in batches:
            found = [own.match(t) for t in as_bytes(batch.column("text"))]
            columns = [[m and own.names[m.template] for m in found], [m and m.dice for m in found], [m and m.first_line for m in found], [m and m.last_line for m in found]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.int32()), strict=True))], names=["doc_id", "license", "dice", "first_line", "last_line"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, dice double, first_line int, last_line int")
