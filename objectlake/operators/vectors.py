"""Nearest vectors and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objectlake.functions import vector
from objectlake.functions.codec import embed, text_embedding


def _constant(v: list[float]) -> Column:
    return F.array(*map(F.lit, map(float, v)))


def search(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "object_id", vector_col: str = "vector") -> DataFrame:
    """The k nearest, (id, score): by cosine from the greatest, by euclidean distance from the least; then by id."""
    score = getattr(vector, metric)(F.col(vector_col), _constant(query))
    scored = vectors.select(id_col, score.alias("score"))
    return scored.orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), id_col).limit(k)


def search_all(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "object_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, score, rank) for each row of queries: every pair is scored, and only k of each query leave a task."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("__q"))
    score = getattr(vector, metric)(F.col(vector_col), F.col("__q"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), id_col)
    return vectors.crossJoin(q).select("query_id", id_col, score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "object_id", vector_col: str = "vector", block_rows: int = 16_384) -> DataFrame:
    """search_all, exactly, for many queries: blocks of vectors and of queries are multiplied as matrices, and only k of each query leave a pair of blocks.

    Rows with a null vector, or a null or non-finite component, are neither queries nor neighbours.
    """
    kinds = [df.schema[id_col].dataType for df in (queries, vectors)]

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return own.where("v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    v, q = usable(vectors), usable(queries)
    n = v.count()
    of_v, of_q = (max(1, -(-rows // block_rows)) for rows in (n, n if queries is vectors else q.count()))

    def placed(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def unit(points: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.divide(points, norms[:, None], out=np.zeros_like(points), where=norms[:, None] > 0)

    def nearest(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(asked):
            return pd.DataFrame({"query_id": asked.id[:0], "object": there.id[:0], "score": np.zeros(0)})
        there = there.iloc[sorted(range(len(there)), key=lambda i, ids=there.id.tolist(): (not pd.isna(ids[i]), None if pd.isna(ids[i]) else ids[i]))]  # places are in the order of ids, nulls first
        sizes_v, sizes_q = there.v.map(len).to_numpy(), asked.v.map(len).to_numpy()
        far = 0.0 if metric == "cosine" else float("inf")
        sides = {}
        for d in np.intersect1d(sizes_v, sizes_q):
            of, at = np.flatnonzero(sizes_v == d), np.flatnonzero(sizes_q == d)
            points = [np.stack(x.v.iloc[i].to_list()).reshape(len(i), d).astype(float) for x, i in ((there, of), (asked, at))]
            norms = [np.sqrt(np.einsum("ij,ij->i", p, p)) for p in points]
            sides[d] = of, at, *points, *norms, *([unit(p, m) for p, m in zip(points, norms)] if metric == "cosine" else points)
        out_q, out_v, out_s = [], [], []
        for start in range(0, len(asked), 256):
            end = min(len(asked), start + 256)
            rough, slack = np.full((end - start, len(there)), -far if metric == "cosine" else far), np.zeros((end - start, 1))
            for of, at, p, x, pn, xn, left, right in sides.values():
                mine = slice(*np.searchsorted(at, (start, end)))
                product = right[mine] @ left.T
                rough[np.ix_(at[mine] - start, of)] = -product if metric == "cosine" else (xn[mine] ** 2)[:, None] + (pn**2)[None, :] - 2 * product
                slack[at[mine] - start, 0] = 1e-9 if metric == "cosine" else 1e-9 * (1 + xn[mine] ** 2 + (pn**2).max())
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if k < len(there) else np.full((end - start, 1), np.inf)
            i, j = np.nonzero(rough <= kth + slack)
            score = np.full(len(i), far)
            for d, (of, at, p, x, pn, xn, *_) in sides.items():
                both = np.flatnonzero((sizes_q[start + i] == d) & (sizes_v[j] == d))
                for part in np.array_split(both, len(both) // 65_536 + 1):
                    a, b = np.searchsorted(at, start + i[part]), np.searchsorted(of, j[part])
                    if metric == "cosine":
                        scale = xn[a] * pn[b]
                        score[part] = np.clip(np.divide(np.einsum("ij,ij->i", x[a], p[b]), scale, out=np.zeros(len(part)), where=scale > 0), -1, 1)
                    else:
                        score[part] = np.sqrt(np.einsum("ij,ij->i", x[a] - p[b], x[a] - p[b]))
            order = np.lexsort((j, -score if metric == "cosine" else score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i)
            good = np.arange(len(i)) - first < k
            out_q.append(start + i[good])
            out_v.append(j[good])
            out_s.append(score[good])
        rows_q, rows_v = np.concatenate(out_q), np.concatenate(out_v)
        return pd.DataFrame({"query_id": asked.id.to_numpy()[rows_q], "object": there.id.to_numpy()[rows_v], "score": np.concatenate(out_s)})

    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("object", kinds[1]), T.StructField("score", T.DoubleType())])
    there, asked = placed(v, "__v", of_v, "__q", of_q), placed(q, "__q", of_q, "__v", of_v)
    found = there.groupBy("__v", "__q").cogroup(asked.groupBy("__v", "__q")).applyInPandas(lambda a, b: nearest(a, b), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), "object")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("object").alias(id_col), "score", "rank")


def search_lsh(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "object_id", vector_col: str = "vector") -> DataFrame:
    """search_all by cosine. Exact, in blocks: neighbours in many dimensions are nearly at right angles, where hyperplanes tell them from the others no better than chance."""
    return search_blocks(vectors, queries, k, "cosine", id_col, vector_col)


def embedded(texts: DataFrame) -> DataFrame:
    """(object_id, vector) of (object_id, text); objects without text are left out."""
    return texts.where("text is not null").select("object_id", text_embedding("text").alias("vector"))


def semantic_search(texts: DataFrame, query: str, k: int = 10) -> DataFrame:
    return search(embedded(texts), embed(query), k)


def similar_to(texts: DataFrame, object_id: str, k: int = 5) -> DataFrame:
    """The k nearest to an object's text without the object itself: usually k - 1. An object without text is an error."""
    own = texts.where((F.col("object_id") == object_id) & F.col("text").isNotNull()).select("text").first()
    if own is None:
        raise KeyError(object_id)
    return semantic_search(texts, own.text, k).where(F.col("object_id") != object_id)
