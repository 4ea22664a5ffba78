"""The quality classifier: held-out accuracy, additivity, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from objectlake.llm import quality as Q
from objectlake.llm.common import table
from tests.llm.helpers import docs, odd, prose, rows

DATA = "/root/testdata/sf0.01"


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int")


def some(spark):
    good = [(i, prose(i, 80)) for i in range(60)]
    bad = [(100 + i, ("BUY NOW!!! $$$ " * 5 + "click ") * (1 + i % 5)) for i in range(60)]
    return docs(spark, good + bad), labels(spark, [(i, int(i < 100)) for i, _ in good + bad])


def test_held_out_accuracy(spark):
    own, known = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    found = {r.doc_id: r.score for r in Q.classified(own, known.where("doc_id % 3 <> 0")).collect()}
    held = [(r.quality, found[r.doc_id]) for r in known.where("doc_id % 3 = 0").collect() if r.doc_id in found]
    assert len(held) > 80
    right = sum((s >= Q.THRESHOLD) == bool(y) for y, s in held)
    assert right >= 0.85 * len(held)
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.9  # the area under the curve


def test_score_is_a_sum_of_table_entries(spark):
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y)
    p = model.score(x)
    assert ((p > 0.5) == y).mean() > 0.95  # only a pair can tell this
    for row, got in zip(x[:20], p):
        bins = [int(np.searchsorted(c, v, side="left")) for c, v in zip(model.cuts, row)]
        total = model.intercept + sum(t[b] for t, b in zip(model.single, bins))
        total += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in model.pairs.items())
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_separates_and_filters(spark):
    own, known = some(spark)
    kept = Q.kept(own, known)
    assert kept.columns == own.columns
    assert {r.doc_id for r in kept.collect()} == set(range(60))


def test_odd_rows(spark):
    own, known = some(spark)
    data = own.unionByName(docs(spark, [(1000 + n if i is not None else None, t) for n, (i, t) in enumerate(odd())]))
    found = Q.classified(data, known)
    assert found.count() == data.count()
    zero = {r.doc_id: (r.score, r.keep) for r in found.collect() if r.doc_id and r.doc_id >= 1000}
    assert zero[1000] == zero[1002] == zero[1003] == (0.0, False)


def test_labels_of_one_kind_or_none(spark):
    own, known = some(spark)
    for l in (known.limit(0), known.where("quality = 1"), labels(spark, [(None, 1), (1, None), (9999, 0)])):
        found = Q.classified(own, l).collect()
        assert {(r.score, r.keep) for r in found} == {(None, True)}
        assert Q.kept(own, l).count() == own.count()


def test_least_label_counts_and_repeated_rows(spark):
    own, known = some(spark)
    again = known.unionByName(known.where("doc_id >= 100").selectExpr("doc_id", "1 as quality"))
    assert {r.doc_id for r in Q.kept(own, again).collect()} == set(range(60))
    twice = own.unionByName(own)
    assert Q.kept(twice, known).count() == 120


def test_empty_table(spark):
    own, known = some(spark)
    assert Q.classified(own.limit(0), known).count() == 0
    assert Q.kept(own.limit(0), known).count() == 0


def test_same_whatever_the_partitions(spark):
    own, known = some(spark)
    assert rows(Q.classified(own.repartition(7), known.repartition(3))) == rows(Q.classified(own.coalesce(1), known))


def test_features():
    f = dict(zip(Q.FEATURES, Q.features("The Cat.\nThe Cat.\n12 !")))
    assert f["repeated_lines"] == pytest.approx(1 / 3)
    assert f["log_words"] == pytest.approx(np.log(7))
    assert f["digits"] == pytest.approx(2 / 22)
    assert Q.features(None) is None
    assert Q.features(" \n") is None


def _plain_split(g, h):
    """The best cut of ordered bins in two, by trying all: (gain, cut)."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    return max(((gain(0, m) + gain(m, len(g)) - gain(0, len(g)), -m) for m in range(1, len(g))), default=(0, 0))


def _plain_tree(g, h, leaves):
    parts = [(0, len(g))]
    while len(parts) < leaves:
        tried = [(*_plain_split(g[a:b], h[a:b]), a, b) for a, b in parts if b - a > 1]
        best = max(tried, key=lambda t: (t[0], -(t[2] - t[1])), default=None)
        if best is None or best[0] <= 1e-9:
            break
        _, m, a, b = best
        parts = sorted([*[p for p in parts if p != (a, b)], (a, a - m), (a - m, b)])
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def _plain_fit(x, y):
    """The whole fit in plain loops; returns the score of each row."""
    import math
    from itertools import combinations

    n, k = len(x), len(x[0])
    sigmoid = lambda f: 1 / (1 + math.exp(-f))
    cuts = [sorted({sorted(r[i] for r in x)[math.floor((n - 1) * q / Q.BINS + 1e-9)] for q in range(1, Q.BINS)}) for i in range(k)]
    bins = [[sum(c < r[i] for c in cuts[i]) for i in range(k)] for r in x]
    f = [math.log(sum(y) / (n - sum(y)))] * n

    def sums(key, size):
        g, h = [0.0] * size, [0.0] * size
        for r in range(n):
            q = sigmoid(f[r])
            g[key(r)] += y[r] - q
            h[key(r)] += q * (1 - q)
        return g, h

    for _ in range(Q.ROUNDS):
        for i in range(k):
            tree = _plain_tree(*sums(lambda r, i=i: bins[r][i], len(cuts[i]) + 1), 3)
            for r in range(n):
                f[r] += Q.RATE * tree[bins[r][i]]
    size = [len(c) + 1 for c in cuts]
    coarse = [[b * Q.GRID // max(s, Q.GRID) if s > Q.GRID else b for b in range(s)] for s in size]

    def grid(i, j):
        """The best tree of depth two over the grid of two features: (gain, values)."""
        a, b = coarse[i][-1] + 1, coarse[j][-1] + 1
        g, h = sums(lambda r: coarse[i][bins[r][i]] * b + coarse[j][bins[r][j]], a * b)
        best = (0.0, [0.0] * (a * b))
        for flip in (False, True):
            at = (lambda u, v: v * b + u) if flip else (lambda u, v: u * b + v)
            outer, inner = (b, a) if flip else (a, b)
            for m in range(1, outer):
                values, gain = [0.0] * (a * b), 0.0
                for half in (range(m), range(m, outer)):
                    gg, hh = ([sum(z[at(u, v)] for u in half) for v in range(inner)] for z in (g, h))
                    tree = _plain_tree(gg, hh, 2)
                    gain += sum(2 * t * p - t * t * q for t, p, q in zip(tree, gg, hh))
                    for u in half:
                        for v in range(inner):
                            values[at(u, v)] = tree[v]
                if gain > best[0] + 1e-12:
                    best = gain, values
        return best

    ranked = sorted(combinations(range(k), 2), key=lambda p: (-grid(*p)[0], p))[: Q.PAIRS]
    for _ in range(Q.ROUNDS // 4):
        for i, j in ranked:
            values, b = grid(i, j)[1], coarse[j][-1] + 1
            for r in range(n):
                f[r] += Q.RATE * values[coarse[i][bins[r][i]] * b + coarse[j][bins[r][j]]]
    return [sigmoid(v) for v in f]


@pytest.mark.parametrize("seed", range(2))
def test_fit_against_plain_loops(seed, monkeypatch):
    monkeypatch.setattr(Q, "ROUNDS", 12)
    monkeypatch.setattr(Q, "BINS", 10)
    monkeypatch.setattr(Q, "GRID", 4)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 3)).round(2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    assert np.allclose(Q.fit(x, y).score(x), _plain_fit(x.tolist(), y.tolist()), atol=1e-6)
