"""Licence notices in texts: MinHash bands over text windows, then exact containment (operator 3).

Texts are read in windows of shingles that overlap by half, one window length per doubling of
template length, so every notice, also one grown by a quarter, lies whole in some window.  Bands of
one minimum retrieve templates from windows; their number is chosen so that a window holding enough
of a template shares a band with it with the wanted probability.  A retrieved template counts when
the window holds enough of its word shingles, compared exactly.  The minima of a window are those of
its two halves, and these those of the halves of the next shorter length, so every shingle is hashed
once per band whatever the number of lengths.  A template shorter than the shingle is one shingle of
its own length, looked up exactly.

Words are compared without punctuation at their edges, and words of punctuation alone (comment
prefixes, rules) do not count, in texts and templates alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemill.llm.common import prepare, text_slices
from tidemill.llm.shingles import Words, distinct_per_document, minhash, minima_columns, shingle_hashes

SHINGLE = 5
#: A template counts when 100 * shared shingles >= PERCENT * its shingles.
PERCENT = 75
#: Chance that bands miss a window that should count.
MISS = 1e-5
SEED = 3
#: A notice may have grown by this share of its shingles and still lies whole in a window.
GROWTH = 0.25
#: Python workers handle at most about this many bytes of text at once (or a single longer text).
SLICE = 1 << 20

#: Public licence notices, from their own texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
#: Whole licence texts, from their own texts.
FULL_TEXTS = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-text-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
}
#: Notices shorter than the shingle.
SHORT_TEMPLATES = {"all-rights-reserved-line": "All rights reserved."}


def half_window(shingles: int, growth: float = GROWTH) -> int:
    """Half the shortest window that holds a run of ``shingles``, grown by ``growth``, wherever it lies."""
    half = 2
    while half < shingles * (1 + growth):
        half *= 2
    return half


def bands_needed(shingles: int, half: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Bands of one minimum that miss a window holding ``percent`` of a template with chance below ``miss``."""
    shared = ceil(shingles * percent / 100)
    similarity = shared / (2 * half + shingles - shared)
    return 1 if similarity >= 1 else ceil(log(miss) / log(1 - similarity))


def _words(column: pa.Array) -> Words:
    """Words without punctuation at their edges; marks beyond ASCII count as punctuation too."""
    return Words(pc.replace_substring_regex(column, r"[^\x00-\x7F\p{L}\p{M}\p{N}]", "."), trim=True)


class Templates:
    """Shingle sets and minima of the templates by name; those shorter than the shingle apart."""

    def __init__(self, texts: dict[str, str], percent: int = PERCENT, size: int = SHINGLE, miss: float = MISS):
        names = sorted(texts)
        words = _words(pa.array([texts[n] for n in names], pa.string()))
        count = np.diff(words.first)
        if (count == 0).any():
            raise ValueError("a template needs a word")
        hashes, bounds = distinct_per_document(*shingle_hashes(words, size))
        sets = [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        #: Per length below the shingle: the one hash of each template and its name.
        self.short: dict[int, dict[int, list[str]]] = {}
        for name, c, s in zip(names, count, sets):
            if c < size:
                self.short.setdefault(int(c), {}).setdefault(int(s[0]), []).append(name)
        long = np.flatnonzero(count >= size)
        self.names, self.percent, self.size = [names[k] for k in long], percent, size
        self.sets = [sets[k] for k in long]
        self.halves = [half_window(len(x)) for x in self.sets]
        self.bands = max((bands_needed(len(x), h, percent, miss) for x, h in zip(self.sets, self.halves)), default=0)
        every = np.concatenate([np.empty(0, np.uint64), *self.sets])
        self.minima = minhash(every, np.append(0, np.cumsum([len(x) for x in self.sets], dtype=np.int64)), self.bands, seed=SEED)


def _hits(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the hashes that are among the sorted ``known``."""
    if not len(known):
        return np.empty(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)


def _levels(bounds: np.ndarray, halves: list[int]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per half-window length, doubling: first shingles, documents, and places in the level below of its pieces.

    Pieces are stretches of a document's shingles; the first level's places are shingles.
    """
    out, half = [], 2
    size = np.diff(bounds)
    below = None
    while halves and half <= max(halves):
        count = -(-size // half)
        ends = np.cumsum(count)
        doc = np.repeat(np.arange(len(size)), count)
        number = np.arange(len(doc)) - np.repeat(ends - count, count)
        first = bounds[doc] + number * half
        place = first if below is None else below[doc] + 2 * number
        out.append((half, first, doc, place))
        below, half = ends - count, half * 2
    return out


def _candidates(hashes: np.ndarray, bounds: np.ndarray, templates: Templates) -> set[tuple[int, int, int]]:
    """(document, first shingle of a window, template) wherever a window and a template share a band."""
    levels = _levels(bounds, templates.halves)
    wanted = {half: [k for k, h in enumerate(templates.halves) if h == half] for half, *_ in levels}
    found: set[tuple[int, int, int]] = set()
    if not len(hashes):
        return found
    for band, least in enumerate(minima_columns(hashes, templates.bands, SEED)):
        for half, first, doc, place in levels:
            least = np.minimum.reduceat(least, place)
            if wanted[half]:
                window = least.copy()
                next_too = doc[1:] == doc[:-1]
                window[:-1][next_too] = np.minimum(least[:-1], least[1:])[next_too]
                for k in wanted[half]:
                    hit = np.flatnonzero(window == templates.minima[k, band])
                    found.update(zip(doc[hit].tolist(), first[hit].tolist(), [k] * len(hit)))
    return found


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    size = templates.size
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE):
            words = _words(piece.column("text"))
            found: dict[tuple[int, str], tuple[float, int]] = {}
            for length, names in templates.short.items():
                hashes, bounds = shingle_hashes(words, length)
                hit = _hits(hashes, np.array(sorted(names), np.uint64))
                doc = np.searchsorted(bounds, hit, side="right") - 1
                for d, p, h in zip(doc.tolist(), (hit - bounds[doc]).tolist(), hashes[hit].tolist()):
                    for name in names[h]:
                        found.setdefault((d, name), (1.0, p))
            hashes, bounds = shingle_hashes(words, size)
            for d, begin, k in sorted(_candidates(hashes, bounds, templates)):
                inside = hashes[begin : min(begin + 2 * templates.halves[k], bounds[d + 1])]
                known = np.isin(inside, templates.sets[k])
                shared = len(np.unique(inside[known]))
                if 100 * shared >= templates.percent * len(templates.sets[k]):
                    first = int(begin - bounds[d] + known.argmax())
                    at = d, templates.names[k]
                    old = found.get(at, (0.0, first))
                    found[at] = (max(old[0], shared / len(templates.sets[k])), min(old[1], first))
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [piece.column("key").take(pa.array([d for d, _ in keys], pa.int64())),
                 pa.array([n for _, n in keys], pa.string()),
                 pa.array([found[x][0] for x in keys], pa.float64()),
                 pa.array([int(words.number[words.first[x[0]] + found[x][1]]) for x in keys], pa.int64())],
                names=["key", "license_id", "containment", "first_word"],
            )


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    percent: int = PERCENT, size: int = SHINGLE, miss: float = MISS,
) -> DataFrame:
    """One row per document and licence found: doc_id, license_id, containment, first_word.

    Words are runs without ASCII white space, A-Z in lower case, without punctuation at their edges;
    shingles are runs of five words, or the whole of a shorter template.  ``containment`` is the largest share of a template's shingles in one window, ``first_word`` the
    number of the first word of its shingles there, among all words of the text.  Null, empty and short texts hold nothing;
    repeated rows are reported each; an empty table or no templates gives an empty result; other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    known = Templates(TEMPLATES | FULL_TEXTS | SHORT_TEMPLATES if templates is None else templates, percent, size, miss)
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    schema = T.StructType([
        T.StructField("key", keyed.schema["key"].dataType), T.StructField("license_id", T.StringType()),
        T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType()),
    ])
    return keyed.mapInArrow(lambda it: _scan(it, known), schema).withColumnRenamed("key", "doc_id")
