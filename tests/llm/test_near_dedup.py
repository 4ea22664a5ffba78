"""Near duplicates against all pairs of fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from objectlake.llm import near_dedup as N
from tests.llm.helpers import changed, docs, odd, prose, rows


def corpus():
    out = [(n, prose(n, 60 + 7 * (n % 20))) for n in range(150)]
    for g in range(15):  # groups of 2 to 16, exact and near
        source = prose(g, 60 + 7 * (g % 20))
        out += [(1000 + 100 * g + i, changed(source, 1000 * g + i, (0.0, 0.02, 0.05)[i % 3])) for i in range(1 + g)]
    return out


def groups(data, radius=N.RADIUS):
    """By all pairs: {doc_id: least doc_id of its component}."""
    fps = [(i, int.from_bytes(f, "big")) for i, t in data if (f := N.fingerprint(t))]
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(fps):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, (i, _) in enumerate(fps)}


def test_same_groups_as_all_pairs(spark):
    want = {i: k for i, k in groups(corpus()).items() if i != k}
    got = {r.doc_id: r.keep_id for r in N.near_duplicates(docs(spark, corpus())).collect()}
    assert len(want) > 100
    assert got == want


def test_copies_are_caught_and_others_stay(spark):
    got = {r.doc_id for r in N.near_duplicates(docs(spark, corpus())).collect()}
    assert not got & set(range(150))
    assert len(got) >= 0.95 * sum(1 + g for g in range(15))


def test_distance(spark):
    data = [(1, prose(1, 200)), (2, changed(prose(1, 200), 5, 0.03)), (3, prose(1, 200))]
    found = {r.doc_id: r.distance for r in N.near_duplicates(docs(spark, data)).collect()}
    a, b = (int.from_bytes(N.fingerprint(t), "big") for _, t in data[:2])
    assert found == {2: (a ^ b).bit_count(), 3: 0}


def _sorted(bits):
    packed = np.unique(np.packbits(bits, axis=1), axis=0).view(">u8").astype(np.uint64)
    packed = packed[np.lexsort((packed[:, 1], packed[:, 0]))]
    return np.ascontiguousarray(packed[:, 0]), np.ascontiguousarray(packed[:, 1])


def _family(seed, k=20, m=6, shares=(0.02, 0.05, 0.2)):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (k, 128), np.uint8)
    return _sorted(np.concatenate([base, *(base ^ (rng.random((k, 128)) < p) for p in shares for _ in range(m))]).astype(np.uint8))


@pytest.mark.parametrize("radius, errors, depth", [(0, 0, 4), (5, 5, 6), (22, 22, 7), (22, 2, 7), (22, 1, 9), (40, 40, 3)])
def test_trie_pairs(radius, errors, depth):
    hi, lo = _family(radius)
    distance = lambda i, j, shift=0: int(np.bitwise_count((hi[i] ^ hi[j]) >> np.uint64(shift))) + (0 if shift else int(np.bitwise_count(lo[i] ^ lo[j])))
    got = [tuple(sorted(p)) for i, j in N.Trie(hi, lo, 0, depth, errors, radius).pairs() for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i, j in combinations(range(len(hi)), 2) if distance(i, j) <= radius and distance(i, j, 64 - depth) <= errors}
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_a_trie(seed):
    """With groups, pairs of what is connected already are spared, and the groups stay the same."""
    hi, lo = _family(seed, 4, 60, (0.03, 0.08))
    groups, all_ = N._Groups(len(hi)), N._Groups(len(hi))
    for _ in N.Trie(hi, lo, 0, 8, 2, 22).pairs(groups):
        pass
    for i, j in N.Trie(hi, lo, 0, 8, 2, 22).pairs():
        all_.add(i, j)
    assert (groups.name == all_.name).all()
    assert len(groups.edges) == len(hi) - len(set(all_.name.tolist()))


def test_many_near_copies_take_no_pairs():
    """A third of all rows in one group of different near copies: time far below that of all pairs."""
    hi, lo = _family(1, 1, 30_000, (0.06,))
    groups = N._Groups(len(hi))
    looked = sum(len(i) for i, _ in N.Trie(hi, lo, 0, 15, 2, 22).pairs(groups))
    assert len(groups.edges) > 0.95 * len(hi)
    assert looked < 50 * len(hi)


@pytest.mark.parametrize("n", [2, 1000, 50_000, 10**6, 30_000_000, 10**9, 5 * 10**10])
@pytest.mark.parametrize("radius", [0, 16, N.RADIUS])
def test_recall_at_the_radius(n, radius):
    """Pairs right at the radius, the farthest that count, stay within the budgets of some trie, however large the table is."""
    plan = N.Plan(n, radius)
    rng = np.random.default_rng(2)
    differing = np.stack([np.isin(np.arange(N.BITS), rng.choice(N.BITS, radius, replace=False)) for _ in range(2000)])
    found = np.zeros(len(differing), bool)
    for order in plan.orders:
        own = differing[:, order]
        found |= ~own[:, : plan.head].any(axis=1) & (own[:, : plan.depth].sum(axis=1) <= plan.errors)
    assert found.sum() >= len(found) - 2
    assert 2**plan.depth >= n


@pytest.mark.parametrize("shard, hot", [(16, 1000), (16, 1), (64, 2)])
def test_shards_and_parts_of_shards(spark, shard, hot):
    """Small shards, and shards cut into parts, give the same groups."""
    data = [(n, t) for n, t in corpus()]
    fps = {N.fingerprint(t) for _, t in data}
    found = N.edges(spark.createDataFrame([(f,) for f in sorted(fps)], "fp binary"), len(fps), shard=shard, hot=hot).collect()
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        a, b = sorted((root(bytes(r.a)), root(bytes(r.b))))
        up[b] = a
    want = groups(data)
    by = {i: N.fingerprint(t) for i, t in data}
    assert {(i, j) for i in want for j in want if want[i] == want[j]} == {(i, j) for i in want for j in want if root(by[i]) == root(by[j])}


def test_components_of_a_long_chain(spark):
    n = 60
    pairs = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in N.components(pairs).collect()}
    assert got == {bytes([i]): b"\0" for i in range(n + 1)}


def test_keep_one(spark):
    data = docs(spark, corpus())
    kept = N.keep_one(data)
    assert kept.columns == data.columns
    got = {r.doc_id for r in N.near_duplicates(data).collect()}
    assert rows(kept, "doc_id") == sorted(((i,) for i, _ in corpus() if i not in got), key=repr)
    assert kept.where("row_key is not null or __row_key is not null").count() == 0


def test_odd_rows(spark):
    data = docs(spark, odd((20, prose(3, 50)), (None, prose(3, 50)), (21, prose(3, 50))))
    found = rows(N.near_duplicates(data), "doc_id", "keep_id")
    assert found == sorted([(5, 5), (None, 20), (21, 20)], key=repr)
    kept = rows(N.keep_one(data), "doc_id")
    assert kept.count((5,)) == 1
    assert len(kept) == data.count() - 3


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_keep_one_by_either_join(spark, threshold):
    """Lists of keys that are broadcast and such that aren't give the same rows, repeated ones among them or not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        once, twice = docs(spark, corpus()), docs(spark, corpus()).union(docs(spark, corpus()))
        gone = {r.doc_id for r in N.near_duplicates(once).collect()}
        want = sorted(((i,) for i, _ in corpus() if i not in gone), key=repr)
        assert rows(N.keep_one(once), "doc_id") == rows(N.keep_one(twice), "doc_id") == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_that_only_differ_in_other_columns(spark):
    data = spark.createDataFrame([(1, "some words here", "en", {"a": 1}), (1, "some words here", "de", {"a": 1}), (1, "some words here", "de", {"a": 2})], "doc_id long, text string, lang string, more map<string,int>")
    got = N.keep_one(data).collect()
    assert len(got) == 1 and got == N.keep_one(data.repartition(3)).collect()


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    assert N.near_duplicates(none).count() == 0
    assert N.keep_one(none).count() == 0
    assert N.keep_one(docs(spark, [(1, None), (2, None)])).count() == 2
