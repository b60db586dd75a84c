"""License scans: winnowed fingerprints of the templates pick candidates, banded alignment measures them.

The words of a template are winnowed: of every ``window`` words in a row the one
with the smallest hash is a fingerprint (of equal ones the last), and an inverted
index maps each fingerprint to the templates that chose it. A fingerprint is one
word, so an edit beside it does not hide it: of a place with a coverage of
``COVERAGE`` at most a known number of words is missing, so at least
``fingerprints - missing`` of them stand in the document, within the template's
length and a band on either side. That is how a candidate is picked. Each
template gets the widest window, of ``WINDOW`` words at most, that leaves more
than half of its fingerprints to count on, so no place is lost.

Around a candidate the equal words are counted by diagonals, and on each
diagonal whose band has enough of them the template's words are aligned to the
document's inside the band. The matched words give coverage and span. Places
with a coverage of ``COVERAGE`` or more are reported; of overlapping places of
one template the one with the most matched words. A place that is only in part
alike and lies inside one of another template with a greater coverage and no
fewer matched words is a place of that other template, and only of it.

The templates are a dictionary that the driver holds, of ``TEMPLATE_BYTES`` of
text at most (more raises a ValueError); every executor gets it once, by a
broadcast. Documents are only scanned, never shuffled.

Defined cases: null and empty texts match nothing; templates without words are
left out; long texts are scanned whole; several places of a template are a row
each; repeated rows give repeated results; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

COVERAGE = 0.8
WINDOW = 4
TEMPLATE_BYTES = 16 << 20
_BITS = 18
SCHEMA = "doc_id long, license string, coverage double, matched_words long, start long, stop long"

_CC_NAMES = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
    *(f"CC-{code}-{version}" for code in _CC_NAMES for version in ("4.0", "3.0")),
]
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""

# Notices and statements of public licenses. Some differ in a word; a text equally near several of them has a row for each.
TEMPLATES = {
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-3-Clause/statement": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0/statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0/notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT/statement": "Released under the MIT License.",
    "MIT/notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0/notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MPL-2.0/statement": "Licensed under the Mozilla Public License, Version 2.0.",
    "MIT/licensed": "Licensed under the MIT License.",
    "GPL-2.0/statement": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1/statement": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0/statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL/notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0/statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "BSD-2-Clause/notice": f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_DISCLAIMER}",
    "BSD-3-Clause/notice": f"""{_BSD_GRANT} {_BSD_CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    "ISC/notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""",
    "ISC/statement": "Released under the ISC License.",
    "Unlicense/notice": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0/statement": "This work is licensed under a Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    "CC0-1.0/short": "Licensed under CC0 1.0.",
} | {
    f"CC-{code}-{version}/{form}": text
    for code, name in _CC_NAMES.items()
    for version, scope in (("4.0", "International"), ("3.0", "Unported"))
    for form, text in (("statement", f"This work is licensed under a Creative Commons {name} {version} {scope} License."), ("short", f"Licensed under CC {code} {version}."))
} | {f"{code}/spdx": f"SPDX-License-Identifier: {code}" for code in _SPDX}


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the smallest hash of every ``window`` in a row, of equal ones the last."""
    window = min(window, len(h))
    runs = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - runs.argmin(axis=1))


class _Index:
    """Fingerprints of the templates: which templates chose them, and how many of them a place cannot be without."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names, self.words = [], []
        for name, text in sorted(templates.items()):
            h, _, _ = common.word_hashes(text)
            if len(h):
                self.names.append(name)
                self.words.append(h)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.bands = np.maximum(1, np.minimum(16, self.sizes // 4))
        self.need = _needed(self.sizes, coverage)
        self.reach = self.sizes + 2 * self.bands
        self.order = [np.argsort(w, kind="stable") for w in self.words]
        self.sorted = [w[o] for w, o in zip(self.words, self.order, strict=True)]
        prints, hits = [], []
        for w, missing in zip(self.words, (self.sizes - self.need).tolist(), strict=True):
            places = next(p for n in range(WINDOW, 0, -1) if len(p := winnowed(w, n)) > 2 * missing or n == 1)
            prints.append(np.unique(w[places]))
            hits.append(max(1, len(places) - missing))
        self.hits = np.array(hits, np.int64)
        self.keys = np.unique(np.concatenate([*prints, np.zeros(0, np.uint64)]))
        self.near = np.zeros(1 << _BITS, bool)
        self.near[self.keys >> np.uint64(64 - _BITS)] = True
        # (fingerprint, template) pairs by fingerprint
        word = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(self.keys, p) for p in prints)])
        by = np.argsort(word, kind="stable")
        self.holders = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p), t) for t, p in enumerate(prints))])[by]
        self.first = np.searchsorted(word[by], np.arange(len(self.keys) + 1))

    def places(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, its places, the document's places) of the equal words around each candidate."""
        at = np.flatnonzero(self.near[h >> np.uint64(64 - _BITS)])
        if not len(at):
            return
        word = np.searchsorted(self.keys, h[at])
        own = self.keys[np.minimum(word, len(self.keys) - 1)] == h[at]
        at, word = at[own], word[own]
        n = self.first[word + 1] - self.first[word]
        rows = np.repeat(np.arange(len(at)), n)
        holder = self.holders[np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + self.first[word][rows]]
        for t in np.flatnonzero(np.bincount(holder, minlength=len(self.sizes)) >= self.hits).tolist():
            reach, hits, need = int(self.reach[t]), int(self.hits[t]), int(self.need[t])
            p = at[rows[holder == t]]
            last = p[hits - 1 :]
            first = p[: len(p) - hits + 1]
            close = last - first < reach
            # the words of a place are within its reach of each of its fingerprints
            p = _covered(len(h), last[close] - reach + 1, first[close] + reach)
            p = p[_holds(self.sorted[t], h[p])]
            a = np.flatnonzero(p[need - 1 :] - p[: max(0, len(p) - need + 1)] < reach)
            if not len(a):
                continue
            p = p[_covered(len(p), a, a + need)]
            lo, hi = np.searchsorted(self.sorted[t], h[p], "left"), np.searchsorted(self.sorted[t], h[p], "right")
            p2 = np.repeat(p, hi - lo)
            i = self.order[t][np.arange(len(p2)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            yield t, i, p2


def _covered(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places under ``size`` that lie in one of the ranges."""
    inside = np.zeros(size + 1, np.int64)
    np.add.at(inside, np.maximum(begins, 0), 1)
    np.add.at(inside, np.minimum(ends, size), -1)
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def _holds(among: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted ``among``."""
    return among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h


def _needed(size, coverage: float):
    """The least number of matched words with a share of ``coverage`` in ``size`` words; at least one."""
    return np.maximum(1, np.ceil(size * coverage - 1e-9).astype(np.int64))


def _align(template: list[int], doc: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last place in ``doc``) of the best alignment whose steps stay within ``band`` of ``diagonal``."""
    n = len(doc)
    above: dict[int, tuple[int, int]] = {}  # place after -> (matches, minus span start)
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int]] = {}
        best = (0, 0)
        for j in range(max(0, i + diagonal - band), min(n, i + diagonal + band + 1)):
            here = max(above.get(j + 1, (0, 0)), best)
            if doc[j] == word:
                m, s = above.get(j, (0, 0))
                here = max(here, (m + 1, s if m else j))
            row[j + 1] = best = here
        above = row
    if not above:
        return 0, 0, 0
    matched = max(v[0] for v in above.values())
    end, (_, start) = min((j, v) for j, v in above.items() if v[0] == matched)
    return matched, start, end - 1


def matches(h: np.ndarray, index: _Index) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first word, last word) of each place in a document's word hashes."""
    out = []
    for t, i, j in index.places(h):
        template, band = index.words[t], int(index.bands[t])
        n, need = len(template), int(index.need[t])
        order = np.argsort(j - i, kind="stable")
        d, i = (j - i)[order], i[order]
        tried = np.unique((np.unique(d)[:, None] + np.arange(-band, band + 1)[None, :]).ravel())
        lo, hi = np.searchsorted(d, tried - band, "left"), np.searchsorted(d, tried + band, "right")
        often = np.flatnonzero(hi - lo >= need)
        most = {int(tried[k]): len(np.unique(i[lo[k] : hi[k]])) for k in often}  # no alignment there matches more words
        found: list[tuple[int, int, int, int]] = []
        words = template.tolist()
        best: dict[int, int] = {}
        for x, bound in sorted(most.items(), key=lambda e: (-e[1], e[0])):
            reach = min(band, n // 2)
            if bound < need or any(best.get(x + y, -1) >= bound for y in range(-reach, reach + 1)):
                continue
            low, high = max(0, x - band), min(len(h), x + n + band)
            matched, first, last = _align(words, h[low:high].tolist(), x - low, band)
            best[x] = matched
            if matched >= need:
                found.append((matched, low + first, low + last, x))
        kept: list[tuple[int, int, int]] = []
        for matched, first, last, _ in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if all(last < a or first > b for _, a, b in kept):
                kept.append((matched, first, last))
        out += [(index.names[t], m / n, m, a, b) for m, a, b in sorted(kept, key=lambda k: k[1])]
    return _named(out)


def _named(places: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """The places without those in part alike that lie inside a place of a greater coverage and no fewer matched words."""
    by = sorted(places, key=lambda x: x[3])
    starts, longest = [x[3] for x in by], max((x[4] - x[3] for x in by), default=0)

    def better(p) -> bool:
        around = by[bisect_left(starts, p[3] - longest) : bisect_right(starts, p[3])]
        return any(q[4] >= p[4] and q[1] > p[1] and q[2] >= p[2] for q in around)

    return [p for p in places if p[1] == 1 or not better(p)]


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, start, stop) of each place; offsets in code points, end exclusive."""
    templates = TEMPLATES if templates is None else templates
    if (size := sum(len(t.encode()) for t in templates.values())) > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates, {TEMPLATE_BYTES} at most")
    shipped = docs.sparkSession.sparkContext.broadcast(templates)

    def scan(batches):
        index = _Index(shipped.value, coverage)
        for batch in common.batches(batches):
            rows = []
            for i, h, starts, ends in common.hashed(batch["text"]):
                if len(h) and index.names:
                    rows += [(batch["doc_id"][i], name, c, m, int(starts[a]), int(ends[b])) for name, c, m, a, b in matches(h, index)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "license", "coverage", "matched_words", "start", "stop")
                yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    return common.texts_of(docs).mapInArrow(scan, SCHEMA)
