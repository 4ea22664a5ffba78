"""Exact neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from objectlake.llm import knn as K


def vectors(spark, pairs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in pairs], "vec_id long, embedding array<double>")
    return df.select("*", F.lit("x").alias("shard"), F.lit("x").alias("cell"), F.lit("x").alias("v"), F.lit("x").alias("d"))


def brute(points, k):
    out = []
    ids = [i for i, _ in points]
    x = np.array([v for _, v in points], float)
    for a, i in enumerate(ids):
        d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        others = sorted((d[b], j) for b, j in enumerate(ids) if j != i)[:k]
        out += [(i, n, j, round(float(s), 6)) for n, (s, j) in enumerate(others, 1)]
    return sorted(out)


def same(df, want):
    got = sorted(map(tuple, df.select("vec_id", "rank", "neighbour", "distance").collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


@pytest.mark.parametrize("dim", [2, 16, 64])
@pytest.mark.parametrize("shard_rows", [10_000, 60, 25])
def test_same_as_brute_force(spark, dim, shard_rows):
    rng = np.random.default_rng(dim)
    points = [(int(i) * 3, rng.normal(size=dim) + 4 * (i % 5)) for i in rng.permutation(200)]
    same(K.nearest(vectors(spark, points), 7, shard_rows=shard_rows, block_rows=50), brute(points, 7))


@pytest.mark.parametrize("shard_rows", [10_000, 12])
def test_some_queries_against_all(spark, shard_rows):
    rng = np.random.default_rng(8)
    points = [(int(i), rng.normal(size=5)) for i in range(-20, 180)]
    same(K.nearest(vectors(spark, points), 6, every=10, shard_rows=shard_rows, block_rows=8), [r for r in brute(points, 6) if r[0] % 10 == 0])


def test_visits_are_bounded_by_the_kth_distance():
    """In few dimensions most leaves are never looked at, and the result is that of brute force."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(20_000, 3))
    tree, seen = K.Tree(points, np.arange(20_000), leaf=64), []
    visit = tree._visit
    tree._visit = lambda leaf, q, *more: (seen.append(len(q)), visit(leaf, q, *more))
    d, i = tree.search(points[:200], np.arange(200), 10, np.full(200, np.inf))
    assert sum(seen) < 200 * len(tree.start) / 2 * 0.1
    far = np.sqrt(((points[:200, None] - points[None]) ** 2).sum(axis=2))
    far[np.arange(200), np.arange(200)] = np.inf
    assert np.allclose(d, np.sort(far, axis=1)[:, :10])
    assert (i == np.argsort(far, axis=1)[:, :10]).all()


def test_slices_of_the_boxes(spark):
    rng = np.random.default_rng(4)
    points = [(i, rng.normal(size=4)) for i in range(150)]
    same(K.nearest(vectors(spark, points), 5, shard_rows=20, block_rows=40, side_bytes=200), brute(points, 5))


def test_ties_and_equal_points(spark):
    points = [(i, [i % 3, 0.0]) for i in range(40)]
    same(K.nearest(vectors(spark, points), 20, shard_rows=15), brute(points, 20))
    same(K.nearest(vectors(spark, [(i, [1.0, 2.0]) for i in range(30)]), 10, shard_rows=7), brute([(i, [1.0, 2.0]) for i in range(30)], 10))


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(2)
    points = [(i, 1e4 + rng.normal(size=8)) for i in range(80)]
    same(K.nearest(vectors(spark, points), 4, shard_rows=30), brute(points, 4))


def test_fewer_than_k(spark):
    points = [(1, [0.0]), (2, [1.0]), (3, [5.0])]
    same(K.nearest(vectors(spark, points), 10), brute(points, 10))
    assert K.nearest(vectors(spark, points[:1]), 3).count() == 0
    assert K.nearest(vectors(spark, points), 0).count() == 0


def test_odd_rows(spark):
    good = [(i, [float(i), 1.0]) for i in range(10)]
    bad = [(None, [1.0, 1.0]), (20, None), (21, [1.0, None]), (22, [float("nan"), 1.0]), (23, [float("inf"), 1.0]), (24, [1.0]), (25, []), (3, [3.0, 1.0]), (4, [99.0, 99.0])]
    same(K.nearest(vectors(spark, [*good, *bad]), 3), brute(good, 3))


def test_empty_table(spark):
    assert K.nearest(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert K.nearest(vectors(spark, [(1, None)])).count() == 0


def test_query_against_sql(same_as_sql):
    same_as_sql("op5_exact_top_k")


def test_boxes_are_tight():
    rng = np.random.default_rng(0)
    tree = K.Tree(rng.normal(size=(1000, 3)), np.arange(1000), leaf=16)
    for n in range(len(tree.start)):
        own = tree.points[tree.start[n] : tree.end[n]]
        assert (tree.low[n] == own.min(axis=0)).all()
        assert (tree.high[n] == own.max(axis=0)).all()
        assert tree.left[n] < 0 or abs((tree.end[tree.left[n]] - tree.start[tree.left[n]]) * 2 - len(own)) <= 1
