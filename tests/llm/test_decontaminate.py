"""Decontamination against all windows compared with all items."""

from __future__ import annotations

import numpy as np
import pytest

from objectlake.llm import decontaminate as D
from objectlake.llm.common import words
from tests.llm.helpers import changed, docs, odd, prose, rows

ITEMS = [(n, prose(1000 + n, 12 + 3 * (n % 5))) for n in range(20)] + [(50, prose(1000, 12)), (51, None), (52, ""), (53, "zz"), (None, prose(77, 15))]


def items(spark, data=ITEMS):
    return spark.createDataFrame(data, "item_id long, text string")


def texts():
    out = []
    for n in range(30):
        passage = ITEMS[n % 20][1]
        share = (0.0, 0.05, 0.15, 0.5)[n % 4]
        out.append((100 + n, f"{prose(n, 40 + n)} {changed(passage, n, share)} {prose(500 + n, 30)}"))
    return [*out, (200, ITEMS[3][1]), (201, " ".join(ITEMS[4][1].split()[:-3])), (202, prose(5, 300)), (200, ITEMS[3][1]), (203, prose(77, 15)), (204, "zz top")]


def brute(text, data=ITEMS):
    """By the definition: every window, SimHash within the radius, then the exact similarity."""
    ws, sums = words(text), {}
    for i, t in data:
        item = words(t)
        k = min(3, len(item))
        if not item or len(ws) < k:
            continue
        want, grams = set(D.shingles(item, k)), D.shingles(ws, k)
        if want.isdisjoint(grams):
            continue  # the similarity is 0 everywhere
        if k not in sums:
            sums[k] = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(D.vectors(grams), axis=0)])
        size = min(len(item) - k + 1, len(grams))
        own = D.simhash(D.vectors(D.shingles(item, k)).sum(axis=0, keepdims=True))[0]
        best = (0.0, 0)
        for at in np.flatnonzero(np.bitwise_count(D.simhash(sums[k][size:] - sums[k][:-size]) ^ own) <= D.RADIUS).tolist():
            s = D.similarity(set(grams[at : at + size]), want)
            if s >= D.THRESHOLD and s > best[0]:
                best = s, at
        if best[0]:
            yield i, round(best[0], 6), best[1], best[1] + size + k - 1


def test_same_as_brute_force(spark):
    found = rows(D.contaminated(docs(spark, texts()), items(spark)))
    assert found == sorted(((d, *m) for d, t in texts() for m in brute(t)), key=repr)
    whole = {d for d, t in texts() for _, item in ITEMS if item and " ".join(words(item)) in " ".join(words(t))}
    assert len(whole) >= 12
    assert {d for d, *_ in found} >= whole
    assert 202 not in {d for d, *_ in found}


def test_radius_loses_nothing_that_is_similar(spark):
    """The similarity alone, without fingerprints, finds the same."""
    wide = rows(D.contaminated(docs(spark, texts()), items(spark), radius=63), "doc_id", "item_id")
    found = rows(D.contaminated(docs(spark, texts()), items(spark)), "doc_id", "item_id")
    assert len(set(found) & set(wide)) >= 0.95 * len(wide)


@pytest.mark.parametrize("radius", [3, 8, 17, 28])
def test_multi_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    bench = D.Benchmark([(n, prose(n, 20)) for n in range(40)], 0.4, radius)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 40), replace=False)) for _ in range(400)], np.uint64)
    prints = bench.prints[rng.integers(0, 40, 400)] ^ flips
    want = np.bitwise_count(prints[:, None] ^ bench.prints[None, :]) <= radius
    assert (bench.near(prints, list(range(40))) == want).all()


def test_slices_of_a_large_benchmark(spark):
    whole = rows(D.contaminated(docs(spark, texts()), items(spark)))
    assert rows(D.contaminated(docs(spark, texts()), items(spark), side_bytes=500)) == whole


def test_window_in_the_middle_of_a_long_text(spark):
    text = f"{prose(1, 30_000)} {ITEMS[7][1]} {prose(2, 9000)}"
    found = rows(D.contaminated(docs(spark, [(1, text)]), items(spark)), "item_id", "similarity", "first_word")
    assert found == [(7, 1.0, 30_000)]


def test_odd_rows(spark):
    data = docs(spark, odd((9, ITEMS[0][1]), (None, ITEMS[1][1])))
    assert rows(D.contaminated(data, items(spark)), "doc_id", "item_id") == [(9, 0), (9, 50), (None, 1)]
    kept = D.without_contaminated(data, items(spark))
    assert kept.columns == data.columns
    assert kept.count() == data.count() - 2


def test_empty_tables(spark):
    some = docs(spark, [(1, "a text")])
    assert D.contaminated(some.limit(0), items(spark)).count() == 0
    assert D.contaminated(some, items(spark).limit(0)).count() == 0
    assert D.without_contaminated(some, items(spark).limit(0)).count() == 1
