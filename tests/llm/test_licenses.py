"""Licence scans: the automaton against plain substring search, and found templates."""

from __future__ import annotations

import random

import pytest

from objectlake.llm import licenses as L
from objectlake.llm.common import words
from tests.llm.helpers import docs, odd, prose, rows


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(L.TEMPLATES, L.MIN_RUN, L.GAP, L.COVER)


@pytest.mark.parametrize("seed", range(8))
def test_matching_statistics(seed):
    """The longest suffix so far that occurs in a sequence, and where it ends there."""
    rng = random.Random(seed)
    sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(4)]
    stream = [rng.randrange(4) for _ in range(60)]
    auto = L.Automaton(sequences)
    for i, (state, length) in enumerate(auto.statistics(stream), 1):
        ends = lambda run: sorted((n, e) for n, s in enumerate(sequences) for e in range(len(run), len(s) + 1) if s[e - len(run) : e] == run)
        want = max(k for k in range(i + 1) if k == 0 or ends(stream[i - k : i]))
        assert length == want
        if length:
            assert auto.ends[state] == ends(stream[i - length : i])


@pytest.mark.parametrize(("name", "template"), L.TEMPLATES)
def test_each_template_is_found(scanner, name, template):
    text = f"{prose(1, 40)} {template} {prose(2, 40)}"
    (got,) = scanner.scan(text)
    assert got[0] == name
    assert words(text[got[1] : got[2]]) == words(template)
    assert got[5] == 1.0


def test_changed_template(scanner):
    name, template = next((n, t) for n, t in L.TEMPLATES if n == "MIT" and len(t) > 300)
    ws = template.split()
    ws[20:22] = ["other", "things"]
    ws[50:50] = ["inserted"]
    (got,) = scanner.scan(f"x {' '.join(ws)} y")
    assert got[0] == name
    assert 0.9 < got[5] < 1


def test_two_findings_and_repeated_licence(scanner):
    text = "Released under the MIT License. " + prose(1, 30) + " Licensed under CC BY 4.0. " + prose(2, 30) + " Released under the MIT License."
    assert [g[0] for g in scanner.scan(text)] == ["MIT", "CC-BY-4.0", "MIT"]


def test_longer_template_wins(scanner):
    assert [g[0] for g in scanner.scan(L.TEMPLATES[1][1])] == ["Apache-2.0"]
    assert [g[0] for g in scanner.scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]


def test_clean_texts(scanner):
    for n in range(20):
        assert scanner.scan(prose(n, 300)) == []
    assert scanner.scan("the copyright holder may use this software for any purpose") == []


def test_repeated_text_of_one_licence(scanner):
    text = "Released under the MIT License. " * 300
    assert [g[0] for g in scanner.scan(text)] == ["MIT"] * 300


def test_time_of_many_findings(scanner):
    """Twenty thousand notices in one text take no more than in proportion."""
    import time

    took = []
    for n in (2000, 20_000):
        began = time.time()
        assert len(scanner.scan("Released under the MIT License. See the file. " * n)) == n
        took.append(time.time() - began)
    assert took[1] < 25 * took[0] + 2


@pytest.mark.parametrize("seed", range(40))
def test_chains_against_all_chains(scanner, seed):
    """The best chain is the best of all that keep the rules; no two overlap."""
    rng = random.Random(seed)
    anchors = sorted({(rng.randint(0, 60), rng.randint(0, 30), rng.randint(3, 8)) for _ in range(9)})

    def follow(a, b):
        lap = max(0, a[0] + a[2] - b[0], a[1] + a[2] - b[1])
        return b[2] - lap if a[0] < b[0] and a[1] < b[1] and lap < b[2] and b[0] - (a[0] + a[2]) <= scanner.gap else None

    def longest(end):
        return max([end[2], *(longest(a) + more for a in anchors if (more := follow(a, end)) is not None)])

    got = list(scanner.chains(anchors))
    assert got[0][4] == max(map(longest, anchors))
    assert [g[4] for g in got] == sorted((g[4] for g in got), reverse=True)
    assert all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(got) for b in got[i + 1 :])


def _plain_scan(text, template, min_run=3):
    """Share of the template that the longest run of its tokens in the text covers, by comparison of all places."""
    a, b = words(text), words(template)
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best / len(b)


@pytest.mark.parametrize("cut", [0, 2, 5, 9, 14])
def test_same_as_brute_force_where_a_run_decides(cut):
    """One template, of whose end words are missing: found exactly where the longest run covers enough."""
    template = " ".join(f"w{i}" for i in range(20))
    one = L.Scanner([("X", template)], L.MIN_RUN, L.GAP, L.COVER)
    text = f"{prose(cut, 30)} {' '.join(template.split()[: 20 - cut])} {prose(cut + 1, 30)}"
    share = _plain_scan(text, template)
    got = one.scan(text)
    assert [g[5] for g in got] == ([round(share, 6)] if share >= L.COVER else [])


_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This program is free software: " + _GNU.format("Affero", "3"), ["AGPL-3.0"]),
        ("This program is free software: " + _GNU.format("Lesser", "3"), ["LGPL-3.0"]),
        ("This program is free software; " + _GNU.format("", "2"), ["GPL-2.0"]),
        ("This library is free software; " + _GNU.format("Lesser", "2.1"), ["LGPL-2.1"]),
        ("This program is free software: " + _GNU.format("", "3"), ["GPL-3.0"]),
        ("Licensed under the Apache License, Version 1.1", []),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("Licensed under the BSD 2-Clause License.", []),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ],
)
def test_relatives_are_told_apart(scanner, text, want):
    assert [g[0] for g in scanner.scan(text)] == want


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"])
def test_whole_texts(scanner, name):
    """Found as one stretch, also with a word in fifty replaced."""
    text = max((t for n, t in L.TEMPLATES if n == name), key=len)
    assert len(words(text)) > 700
    ws = text.split()
    ws[25::50] = ["xyz"] * len(ws[25::50])
    (got,) = scanner.scan(" ".join(ws))
    assert got[0] == name
    assert got[5] > 0.9


def test_affero_text_is_no_gpl(scanner):
    text = max((t for n, t in L.TEMPLATES if n == "GPL-3.0"), key=len).replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    assert "GPL-3.0" not in [g[0] for g in scanner.scan(text) if g[2] - g[1] > 5000]


def test_whole_mit_with_its_warranty(scanner):
    text = max((t for n, t in L.TEMPLATES if n == "MIT"), key=len)
    (got,) = scanner.scan(f"Copyright 2020 {text} end")
    assert text.endswith("DEALINGS IN THE SOFTWARE.")
    assert words(f"Copyright 2020 {text} end"[got[1] : got[2]]) == words(text)


def test_table(spark):
    data = docs(spark, odd((20, "Released under the MIT License."), (None, "Released under the MIT License."), (20, "Released under the MIT License.")))
    got = rows(L.scan(data), "doc_id", "license", "start", "end", "coverage")
    assert got == sorted([(20, "MIT", 0, 30, 1.0)] * 2 + [(None, "MIT", 0, 30, 1.0)], key=repr)


def test_empty(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    assert L.scan(none).count() == 0
    assert L.scan(docs(spark, [(1, "Released under the MIT License.")]), []).count() == 0
