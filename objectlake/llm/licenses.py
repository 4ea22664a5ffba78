"""Licence scans: a generalised suffix automaton of licence texts, streamed over documents.

The automaton has every run of tokens of every template. A document's tokens are fed to it one at a
time; the state after each gives the longest run that ends there and occurs in a template (the
matching statistic). Runs of MIN_RUN tokens and more that can't be extended become
anchors; for each template, anchors that follow each other in the document and in the template,
at most GAP tokens apart, are chained, and a chain that covers enough of the template is a finding, if the words and versions
that tell the licence from its relatives (Affero, Lesser, NC, 1.1) are those of the template.
Stretches of a document without MIN_RUN known tokens in a row can't hold an anchor and are skipped.

Defined cases: null and empty texts have no findings; an empty table gives an empty result. Very long texts are read whole, in time that grows with their length. A licence that occurs several times in a
document is found each time. A finding inside a longer one of another template is left out; of equal
ones the template that comes first in the alphabet stays. Repeated rows each give their own findings;
ids may be null; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from objectlake.llm.common import id_text, map_arrow, spans, table, words

#: Shortest run that counts, tokens between two runs of a chain, and share of a template that a chain has to cover.
MIN_RUN, GAP, COVER = 3, 12, 0.75

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'

#: (licence, notice or text)
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_MIT_TAIL = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_REST = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_TAIL = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _header(what: str, name: str, version: str, mark: str = ";") -> str:
    return f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your option) any later version."


_OF = {n: [t for m, t in TEMPLATES if m == n] for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
TEMPLATES += [
    ("MIT", _OF["MIT"][2] + _MIT_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_REST),
    ("BSD-3-Clause", _OF["BSD-3-Clause"][0].removesuffix(_BSD_TAIL) + _BSD_REST),
    ("ISC", _OF["ISC"][0] + _ISC_TAIL),
    ("GPL-2.0", _header("program", "General Public License", "2")),
    ("LGPL-2.0", _header("library", "Library General Public License", "2")),
    ("LGPL-2.1", _header("library", "Lesser General Public License", "2.1")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", _header("program", "Lesser General Public License", "3", ":")),
    ("AGPL-3.0", _header("program", "Affero General Public License", "3", ":")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    *[(f"CC-{'-'.join(k)}-4.0", f"Licensed under CC {'-'.join(k)} 4.0.") for k in (("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND"))],
    *[
        (f"CC-BY-{short}-4.0", f"This work is licensed under a Creative Commons Attribution-{long} 4.0 International License.")
        for short, long in (("SA", "ShareAlike"), ("ND", "NoDerivatives"), ("NC", "NonCommercial"), ("NC-SA", "NonCommercial-ShareAlike"), ("NC-ND", "NonCommercial-NoDerivatives"))
    ],
    *[(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted((files("objectlake.llm") / "license_texts").iterdir(), key=lambda f: f.name)],
]

#: What tells a licence from its relatives: words of its name, and versions. Templates of more than NOTICE tokens are whole texts, told by their titles.
_NAMED = re.compile(r"\b(?:(affero)|(lesser)|(library)\s+general|(nc|non-?commercial)|(sa|share-?alike)|(nd|no-?deriv\w*))\b", re.IGNORECASE)
_VERSION = re.compile(r"(?:\b(?:version|v|by|nc|sa|nd|attribution|noncommercial|sharealike|noderivatives|bsd)|public\s+license)[\s.,]*([0-9]+(?:\.[0-9]+)*)", re.IGNORECASE)
NOTICE, TITLE = 200, 12


def _named(text: str) -> set[int]:
    return {m.lastindex for m in _NAMED.finditer(text)}


def _versions(text: str) -> set[str]:
    return {re.sub(r"(?:\.0)+$", "", v) for v in _VERSION.findall(text)}


class Automaton:
    """Suffix automaton of several token sequences."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]

        def new(length: int, link: int, edges: dict[int, int]) -> int:
            self.next.append(edges)
            self.link.append(link)
            self.length.append(length)
            ends.append(set())
            return len(self.next) - 1

        def clone(p: int, q: int, token: int) -> int:
            c = new(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = c
            while p >= 0 and self.next[p].get(token) == q:
                self.next[p][token] = c
                p = self.link[p]
            return c

        for n, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                if (q := self.next[last].get(token)) is not None:
                    last = q if self.length[q] == self.length[last] + 1 else clone(last, q, token)
                else:
                    p, last = last, new(self.length[last] + 1, 0, {})
                    while p >= 0 and token not in self.next[p]:
                        self.next[p][token] = last
                        p = self.link[p]
                    if p >= 0:
                        q = self.next[p][token]
                        self.link[last] = q if self.length[q] == self.length[p] + 1 else clone(p, q, token)
                ends[last].add((n, at + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run that ends here) after each token."""
        state, length = 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if t in self.next[state]:
                state, length = self.next[state][t], length + 1
            yield state, length


class _Free:
    """Stretches that don't overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Whether the stretch is free; then it no longer is."""
        i = bisect_left(self.starts, end)  # those before i begin before the end
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], min_run: int, gap: int, cover: float) -> None:
        self.names, sequences = [n for n, _ in templates], [words(t) for _, t in templates]
        self.size = [len(s) for s in sequences]
        self.ids = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])
        self.min_run, self.gap, self.cover = min_run, gap, cover
        titles = [" ".join(ws[:TITLE]) if len(ws) > NOTICE else t for ws, (_, t) in zip(sequences, templates)]
        self.named, self.versions = [_named(t) for t in titles], [_versions(t) if n <= NOTICE else set() for n, t in zip(self.size, titles)]

    def fits(self, text: str, at: list[tuple[int, int]], template: int, chain: tuple[int, int, int, int, int]) -> bool:
        """Whether the stretch of the text has the template's name and version, not those of a relative."""
        d0, d1, t0, *_ = chain
        if self.size[template] > NOTICE:
            return t0 >= TITLE or _named(text[at[max(0, d0 - 3)][0] : at[min(len(at), d0 + TITLE) - 1][1]]) == self.named[template]
        return _named(text[at[d0][0] : at[d1 - 1][1]]) == self.named[template] and self.versions[template] <= _versions(text[at[d0][0] : at[min(len(at), d1 + 2) - 1][1]])

    def anchors(self, ws: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """By template: (first token in the document, first in the template, length) of each run that can't be extended."""
        get = self.ids.get
        known = np.fromiter((get(w, -1) for w in ws), np.int32, len(ws))
        edge = np.flatnonzero(np.diff(np.r_[0, (known >= 0).astype(np.int8), 0]))
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start < self.min_run:
                continue
            found = list(self.automaton.statistics(known[start:end].tolist()))
            for i, (state, length) in enumerate(found):
                if length >= self.min_run and (i + 1 == len(found) or found[i + 1][1] <= length):
                    for template, stop in self.automaton.ends[state]:
                        out[template].append((start + i + 1 - length, stop - length, length))
        return out

    def chains(self, anchors: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(first and end token in the document, first and end in the template, tokens covered), best first, without overlaps."""
        anchors = sorted(anchors)
        best, head = [a[2] for a in anchors], list(range(len(anchors)))
        longest = max(best, default=0)
        for i, (d, t, n) in enumerate(anchors):
            for j in range(i - 1, -1, -1):
                dj, tj, nj = anchors[j]
                if d - dj > self.gap + longest:
                    break
                # anchors may overlap by a few tokens; the later one then counts without them
                lap = max(0, dj + nj - d, tj + nj - t)
                if dj < d and tj < t and lap < n and d - (dj + nj) <= self.gap and best[j] + n - lap > best[i]:
                    best[i], head[i] = best[j] + n - lap, head[j]
        free = _Free()
        for i in sorted(range(len(anchors)), key=lambda i: (-best[i], i)):
            d0, d1 = anchors[head[i]][0], anchors[i][0] + anchors[i][2]
            if free.take(d0, d1):
                yield d0, d1, anchors[head[i]][1], anchors[i][1] + anchors[i][2], best[i]

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int, float]]:
        """(licence, first and end character, first and end token of the template, share of the template) of each finding."""
        if not (by := self.anchors(words(text))):
            return []
        found, at = [], None
        for t, anchors in by.items():
            if sum(a[2] for a in anchors) >= self.cover * self.size[t]:
                at = at or spans(text)
                found += [(c[4], self.names[t], t, c) for c in self.chains(anchors) if c[4] >= self.cover * self.size[t] and self.fits(text, at, t, c)]
        out, free = [], _Free()
        for covered, name, t, (d0, d1, t0, t1, _) in sorted(found, key=lambda x: (-x[0], -x[0] / self.size[x[2]], x[1], x[2], x[3])):
            if free.take(d0, d1):
                out.append((name, at[d0][0], at[d1 - 1][1], t0, t1, round(covered / self.size[t], 6)))
        return sorted(out, key=lambda x: x[1:])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """(doc_id, license, start, end, template_start, template_end, coverage) of each finding; start and end in characters, the template's in tokens."""
    scanner = Scanner(TEMPLATES if templates is None else templates, min_run, gap, cover)
    names = ("doc_id", "license", "start", "end", "template_start", "template_end", "coverage")

    def step(batch: pa.RecordBatch) -> dict:
        rows = [(d, *f) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for f in scanner.scan(t)]
        return dict(zip(names, zip(*rows) if rows else [[]] * 7))

    return map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, license string, start int, end int, template_start int, template_end int, coverage double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
