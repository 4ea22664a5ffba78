"""Exact nearest neighbours, with a KD-tree in each shard.

Vectors are sharded by the cells of a coarse KD-tree over a bounded sample, cells that hold more than
`shard_rows` vectors by the hash of the id as well; the sample only affects speed. Each shard gets a tree of median splits
along the widest side, whose nodes keep the tight bounding boxes of their points. A query visits shards in the order
of the distance of their boxes, in rounds: the nearest one first, then a few, then the rest. After each round its kth distance
is the bound for the next, so that it goes on only to shards whose box it reaches. Within a shard it
visits the leaves from the nearest box outwards until the next box is farther than its kth distance. Visits are batched:
all queries whose next leaf is the same are compared with it by one product of matrices; what may be near enough by
that is then measured exactly.

Queries are all vectors, or those whose id is divisible by `every`, against all vectors. Work is cut into
pairs of a shard and a block of queries, both of bounded size, and a tree is sent only to blocks
that have queries for it. The boxes of the shards are held by each worker in slices of at most SIDE_BYTES.

Distances are Euclidean, in double precision; equal ones are ordered by id. Exact: same result as brute force.

Defined cases: rows with a null id, a null vector, a null or non-finite component, or another dimension than
most vectors have (of equally common ones the greatest) are neither queries nor neighbours. Of rows with the same id the least vector
counts. With fewer than k others, there are fewer neighbours. An empty table, and one without usable vectors, gives an empty result.
Further columns are not read, so that texts of any length don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objectlake.llm.common import SIDE_BYTES, cut, least, table, workers

#: Neighbours; vectors in a shard, queries in a block, points in a leaf; rows that the cells are cut on; of these ids every so many is a query in op5.
K, SHARD_ROWS, BLOCK_ROWS, LEAF, SAMPLE, EVERY = 10, 16_384, 16_384, 512, 8192, 50
#: How many shards a query has visited after each round.
ROUNDS = (1, 4)


class Tree:
    """Points in the order of the leaves; nodes as arrays: rows start:end, children (-1 in a leaf), box."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(points))
        self.start, self.end, self.left, self.right, low, high = [], [], [], [], [], []

        def add(a: int, b: int) -> int:
            own, node = points[order[a:b]], len(self.start)
            for to, x in ((self.start, a), (self.end, b), (self.left, -1), (self.right, -1), (low, own.min(axis=0)), (high, own.max(axis=0))):
                to.append(x)
            wide = int(np.argmax(high[node] - low[node]))
            if b - a > leaf and high[node][wide] > low[node][wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
                self.left[node] = add(a, a + middle)
                self.right[node] = add(a + middle, b)
            return node

        add(0, len(points))
        self.low, self.high = np.array(low), np.array(high)
        self.points, self.ids = points[order], ids[order]
        self.norms = (self.points * self.points).sum(axis=1)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the boxes of nodes, pair by pair."""
        d = np.maximum(np.maximum(self.low[nodes] - queries, queries - self.high[nodes]), 0)
        return np.einsum("ij,ij->i", d, d)

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest points that have another id and are not farther than the squared limit; inf and -1 where there are fewer."""
        n = len(queries)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        slack = 1e-9 * (1 + (queries * queries).sum(axis=1) + (self.norms.max() if len(self.norms) else 0.0))
        leaves_q, leaves_n, leaves_b = [], [], []
        for at in range(0, n, 2048):  # down the tree; whole subtrees beyond the limit fall away
            q = np.arange(at, min(n, at + 2048))
            node = np.zeros(len(q), np.int64)
            left, right = np.array(self.left), np.array(self.right)
            while len(q):
                parts = [(q[i : i + 65_536], node[i : i + 65_536]) for i in range(0, len(q), 65_536)]
                bound = np.concatenate([self.bounds(queries[a], b) for a, b in parts])
                keep = bound <= limit[q] + slack[q]
                q, node, bound = q[keep], node[keep], bound[keep]
                leaf = left[node] < 0
                leaves_q.append(q[leaf])
                leaves_n.append(node[leaf])
                leaves_b.append(bound[leaf])
                q, node = np.r_[q[~leaf], q[~leaf]], np.r_[left[node[~leaf]], right[node[~leaf]]]
        q, node, bound = map(np.concatenate, (leaves_q, leaves_n, leaves_b))
        order = np.lexsort((node, bound, q))
        q, node, bound = q[order], node[order], bound[order]
        first = np.searchsorted(q, np.arange(n + 1))
        step = 0
        active = np.flatnonzero(first[1:] > first[:-1])
        while len(active):
            at = first[active] + step
            near = bound[at] <= np.minimum(limit[active], best_d[active, -1]) + slack[active]
            active, at = active[near], at[near]  # boxes come nearest first: a query that is past its kth distance is done
            by_leaf = np.argsort(node[at], kind="stable")
            cuts = np.flatnonzero(np.diff(node[at][by_leaf])) + 1
            for part in np.split(by_leaf, cuts) if len(by_leaf) else ():
                self._visit(int(node[at[part[0]]]), active[part], queries, ids, k, limit, slack, best_d, best_i)
            step += 1
            active = active[first[active] + step < first[active + 1]]
        return np.sqrt(best_d), best_i

    def _visit(self, leaf: int, q: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray, slack: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> None:
        rows = slice(self.start[leaf], self.end[leaf])
        points, own = self.points[rows], queries[q]
        for a in range(0, len(points), 4096):  # a leaf of equal points can be of any size
            p = points[a : a + 4096]
            rough = (own * own).sum(axis=1)[:, None] + self.norms[rows][a : a + 4096][None, :] - 2 * own @ p.T
            bound = np.minimum(limit[q], best_d[q, -1]) + slack[q]
            if len(p) > 2 * k:  # of so many points only the k nearest can matter, and those of about the same distance; one may be the query itself
                bound = np.minimum(bound, np.partition(rough, k, axis=1)[:, k] + 2 * slack[q])
            i, j = np.nonzero(rough <= bound[:, None])
            other = self.ids[rows][a : a + 4096][j] != ids[q[i]]
            i, j = i[other], j[other]
            d = own[i] - p[j]
            exact = np.array([], float) if not len(i) else np.einsum("ij,ij->i", d, d)
            good = exact <= limit[q[i]]
            i, j, exact = i[good], j[good], exact[good]
            touched, i = np.unique(i, return_inverse=True)
            m = len(touched)
            group = np.r_[np.repeat(np.arange(m), k), i]
            dist, name = np.r_[best_d[q[touched]].ravel(), exact], np.r_[best_i[q[touched]].ravel(), self.ids[rows][a : a + 4096][j]]
            order = np.lexsort((name, dist, group))
            start = np.searchsorted(group[order], np.arange(m))
            take = order[start[:, None] + np.arange(k)]
            best_d[q[touched]], best_i[q[touched]] = dist[take], name[take]


def _cells(sample: np.ndarray, wanted: int) -> list[tuple[int, float, int, int]]:
    """Coarse splits (dimension, value, left, right); children below 0 are the cells -1, -2, ..."""
    nodes: list[list] = []
    count = 0

    def add(rows: np.ndarray, depth: int) -> int:
        nonlocal count
        wide = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) > 1 else 0
        value = float(np.median(rows[:, wide])) if len(rows) > 1 else 0.0
        below = rows[:, wide] < value if len(rows) else np.zeros(0, bool)
        if not depth or not below.any() or below.all():
            count += 1
            return -count
        node = len(nodes)
        nodes.append([wide, value, 0, 0])
        nodes[node][2] = add(rows[below], depth - 1)
        nodes[node][3] = add(rows[~below], depth - 1)
        return node

    add(sample, max(0, int(np.ceil(np.log2(max(1, wanted))))))
    return [tuple(n) for n in nodes]


def _route(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    for n, (wide, value, left, right) in enumerate(nodes):
        here = at == n
        at[here] = np.where(x[here, wide] < value, left, right)
    return -1 - at


def nearest(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 1, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """(vec_id, rank, neighbour, distance) for each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    workers(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where("vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "vec_id long, rank int, neighbour long, distance double")
    if sizes is None or k < 1:
        return empty
    own = cut(own.where(F.size("v") == sizes["dim"]).groupBy("vec_id").agg(F.min("v").alias("v")))
    sample = np.array([r.v for r in least(own, "vec_id", SAMPLE)])
    nodes = _cells(sample, -(-sizes["count"] // shard_rows))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_route(np.stack(v.to_list()), nodes) if len(v) else [])

    placed = own.withColumn("cell", cell("v"))
    parts = {r.cell: -(-r["count"] // shard_rows) for r in placed.groupBy("cell").count().collect()}  # a row for each cell
    first = {c: sum(n for d, n in parts.items() if d < c) for c in parts}
    of = F.create_map(*[F.lit(x) for c in sorted(parts) for x in (c, first[c])]), F.create_map(*[F.lit(x) for c in sorted(parts) for x in (c, parts[c])])
    sharded = placed.select("vec_id", "v", (of[0][F.col("cell")] + F.pmod(F.xxhash64("vec_id"), of[1][F.col("cell")])).cast("int").alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        points = np.stack(pdf.v.to_list())
        tree = Tree(points, pdf.vec_id.to_numpy())
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "tree": [pickle.dumps(tree, 5)], "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()]})

    trees = cut(sharded.groupBy("shard").applyInPandas(build, "shard int, tree binary, low array<double>, high array<double>"))

    def answer(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(trees):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "d": np.zeros(0), "neighbour": np.zeros(0, np.int64)})
        tree, ids = pickle.loads(trees.tree.iloc[0]), queries.vec_id.to_numpy()
        limit = queries.limit.to_numpy() ** 2
        d, i = tree.search(np.stack(queries.v.to_list()), ids, k, np.where(np.isfinite(limit), limit * (1 + 1e-12), np.inf))
        there = np.isfinite(d)
        return pd.DataFrame({"vec_id": np.repeat(ids, there.sum(axis=1)), "d": d[there], "neighbour": i[there]})

    asking = own.where(F.col("vec_id") % every == 0)
    blocks = (sizes["count"] if every == 1 else asking.count()) // block_rows + 1
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "neighbour"))
    best = None  # (vec_id, d, neighbour), k rows a query at most
    n_slices = len(sample[0]) * 16 * sum(parts.values()) // side_bytes + 1
    for s in range(n_slices):
        mine = trees.where(F.pmod("shard", F.lit(n_slices)) == s)
        boxes = sorted(mine.select("shard", "low", "high").collect())
        if not boxes:
            continue
        names, low, high = np.array([b.shard for b in boxes]), np.array([b.low for b in boxes]), np.array([b.high for b in boxes])
        turns = [0, *(r for r in ROUNDS if r < len(boxes)), len(boxes)]
        for begin, end in zip(turns, turns[1:]):

            def reach(batches: Iterator[pd.DataFrame], names: np.ndarray = names, low: np.ndarray = low, high: np.ndarray = high, begin: int = begin, end: int = end) -> Iterator[pd.DataFrame]:
                """Each query with those of its begin-th to end-th nearest boxes that are within its limit."""
                for pdf in batches:
                    for at in range(0, len(pdf), 256):
                        part = pdf.iloc[at : at + 256]
                        v, limit = np.stack(part.v.to_list()), part.limit.to_numpy() ** 2
                        far = np.empty((len(part), len(names)))
                        for b in range(len(names)):
                            d = np.maximum(np.maximum(low[b] - v, v - high[b]), 0)
                            far[:, b] = np.einsum("ij,ij->i", d, d)
                        order = np.argsort(far, axis=1, kind="stable")[:, begin:end]
                        near = np.take_along_axis(far, order, axis=1) <= (limit + 1e-9 * (1 + (v * v).sum(axis=1)))[:, None]
                        q, nth = np.nonzero(near)
                        yield part.iloc[q].assign(shard=names[order[q, nth]].astype(np.int32))

            bound = None if best is None else best.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.max("d")).alias("limit"))
            asked = asking.withColumn("limit", F.lit(float("inf"))) if bound is None else asking.join(bound, "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
            asked = cut(asked.select("vec_id", "v", "limit").mapInPandas(reach, "vec_id long, v array<double>, limit double, shard int").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
            needed = asked.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block")).distinct()
            there = mine.select("shard", "tree").join(needed, F.col("shard") == F.col("to_shard")).select("to_shard", "to_block", "tree")
            found = there.groupBy("to_shard", "to_block").cogroup(asked.groupBy("shard", "block")).applyInPandas(answer, "vec_id long, d double, neighbour long")
            best = cut((found if best is None else best.unionByName(found)).withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "d", "neighbour"))
    return empty if best is None else best.withColumn("rank", rank).select("vec_id", "rank", "neighbour", F.round("d", 6).alias("distance"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each vector whose id is divisible by EVERY, among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), every=EVERY)


SQL = f"""
with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
pairs as (select a.vec_id, b.vec_id as neighbour, list_distance(a.e, b.e) as d from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
ranked as (select *, row_number() over (partition by vec_id order by d, neighbour) as rank from pairs)
select vec_id, cast(rank as integer) as rank, neighbour, round(d, 6) as distance from ranked where rank <= {K}
"""
