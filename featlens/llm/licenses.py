"""License scans by patience alignment.

Tokens are runs of bytes between ASCII punctuation and white space, A-Z
lowered. A text and a license template are aligned around the words that are
unique to both: the longest increasing subsequence of their places gives
anchors, equal words next to anchors are matched, and the gaps between anchors
are aligned the same way. Coverage is the share of the template's words that
are matched.

A license may stand anywhere in a long text, and more than once, so alignment
runs in windows. A window starts at a word of the template and is half as long
again as the template; it is aligned if it holds so many different words of the
template that the least coverage is still possible. That bound is exact: a
template word that is not in the window cannot be matched. Of a hit and the
windows that start in it, the one that matches most words counts, and of equal
ones the shortest; the scan goes on behind it.

Of hits of several templates that overlap, the one that matches most words
counts (of equal ones the larger share, then the smaller name): a notice inside
a longer one is not reported beside it.

Null and empty texts have no licenses. Repeated rows are scanned each; null
doc_ids are kept; texts of any length are scanned whole; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featlens.llm import text

TABLE = text.byte_table(text.SPACE + b"!\"#$%&'()*+,./:;<=>?@[\\]^`{|}~-")
MIN_COVERAGE = 0.8

#: Notices of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD-2-Clause-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        left, right = _once(a, a0, a1), _once(b, b0, b1)
        chain = _increasing(sorted((i, right[w]) for w, i in left.items() if w in right))
        if not chain:
            continue
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _once(words: list[int], lo: int, hi: int) -> dict[int, int]:
    """Places of the words that stand once in words[lo:hi]."""
    at: dict[int, int] = {}
    for i in range(lo, hi):
        at[words[i]] = -1 if words[i] in at else i
    return {w: i for w, i in at.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, that increases in the second."""
    import bisect

    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tops, j)
        before[n] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[k], ends[k] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Template:
    """A notice's words. find() needs a share of them, and all if they are few: of five words, each tells licenses apart."""

    def __init__(self, name: str, notice: str):
        buf = np.frombuffer(notice.encode(), np.uint8)
        self.name, self.hashes = name, text.Tokens(buf, np.array([0, len(buf)]), TABLE).hash
        words, count = np.unique(self.hashes, return_counts=True)
        self.words, self.count = words, dict(zip(words.tolist(), count.tolist(), strict=True))
        self.list = self.hashes.tolist()
        self.window = len(self.list) * 3 // 2 + 4

    def find(self, hashes: np.ndarray, hits: np.ndarray, least: float) -> list[tuple[int, int, int]]:
        """(first token, end token, matched words) of each hit in a text, given the places of the template's words in it."""
        need = int(np.ceil(least * len(self.list))) if len(self.list) > 5 else len(self.list)
        weight = np.array([self.count[h] for h in hashes[hits].tolist()])
        if weight.sum() < need:  # even with every word counted at each place
            return []
        out, n = [], len(hits)
        held: dict[int, int] = {}
        found, end, i = 0, 0, 0
        best, first, limit = None, 0, 0
        places, words = hits.tolist(), hashes[hits].tolist()
        while i < n or best:
            if best and (i == n or places[i] >= limit or best[2] == len(self.list) == best[1] - best[0]):
                # what is left of the windows before the best may hold an occurrence of its own
                before = hits[(hits >= first) & (hits < best[0])]
                out += [*self.find(hashes[: best[0]], before, least), best]
                i = end = int(np.searchsorted(hits, best[1]))
                held, found, best = {}, 0, None
                continue
            while end < n and places[end] < places[i] + self.window:
                w = words[end]
                held[w] = held.get(w, 0) + 1
                if held[w] <= self.count[w]:
                    found += 1
                end += 1
            if found >= (best[2] if best else need):
                lo, hi = places[i], min(places[i] + self.window, len(hashes))
                pairs = patience(hashes[lo:hi].tolist(), self.list)
                if len(pairs) >= need:
                    hit = (lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs))
                    if not best:
                        best, first, limit = hit, lo, hit[1]
                    elif (hit[2], hit[0] - hit[1]) > (best[2], best[0] - best[1]):
                        best = hit
            w = words[i]
            if held[w] <= self.count[w]:
                found -= 1
            held[w] -= 1
            i += 1
        return out


def apart(found: list[tuple[Template, int, int, int]]) -> list[tuple[Template, int, int, int]]:
    """Of hits (template, first word, end, matched) that overlap, the one with most matched words, of equal ones the one with the larger share, then the smaller name."""
    kept: list[tuple[Template, int, int, int]] = []
    for hit in sorted(found, key=lambda h: (-h[3], -h[3] / len(h[0].list), h[0].name, h[1])):
        if not any(hit[1] < e and s < hit[2] for _, s, e, _ in kept):
            kept.append(hit)
    return kept


def scan(documents: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """documents' doc_id and licenses: array of (license, start, end, matched, coverage), by start; offsets are code points.

    The templates go to every task: they are a short list given as a parameter.
    """
    notices = TEMPLATES if templates is None else templates
    one = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])

    def scanned(batches):
        known = [t for t in (Template(n, x) for n, x in notices.items()) if t.list]
        every = text.Lookup(np.unique(np.concatenate([t.words for t in known]))) if known else text.Lookup(np.zeros(0, np.uint64))
        rarest = min((int(np.ceil(min_coverage * len(t.list))) for t in known), default=1)
        masks = [np.concatenate([[False], np.isin(every.known, t.words)]) for t in known]
        for b in batches:
            out = []
            for lo, hi, buf, offs in text.slices(b.column("text")):
                toks = text.Tokens(buf, offs, TABLE)
                hashes = toks.hash
                ids = every(hashes)
                places = np.flatnonzero(ids)
                edges = np.searchsorted(places, toks.of_doc)
                for d in range(hi - lo):
                    found = []
                    hits = places[edges[d] : edges[d + 1]]
                    if len(hits) >= rarest:
                        first = toks.of_doc[d]
                        own = hashes[first : toks.of_doc[d + 1]]
                        for t, mask in zip(known, masks, strict=True):
                            mine = hits[mask[ids[hits]]] - first
                            # all but the template's repeated words must stand in a text that covers it
                            if len(np.unique(own[mine])) >= len(t.words) - (1 - min_coverage) * len(t.list):
                                found += [(t, a + first, e + first, m) for a, e, m in t.find(own, mine, min_coverage)]
                    if not found:
                        out.append([])
                        continue
                    found = apart(found)
                    spans = np.array([(toks.start[a], toks.end[e - 1]) for _, a, e, _ in found]) - offs[d]
                    points = text.code_points(buf[offs[d] : offs[d + 1]], spans.ravel()).reshape(-1, 2).tolist()
                    rows = [{"license": t.name, "start": s, "end": e, "matched": m, "coverage": m / len(t.list)} for (t, _, _, m), (s, e) in zip(found, points, strict=True)]
                    out.append(sorted(rows, key=lambda r: (r["start"], r["license"])))
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.list_(one))], ["doc_id", "licenses"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scanned, f"doc_id {doc_id}, licenses array<struct<license:string,start:bigint,end:bigint,matched:bigint,coverage:double>>")
