"""Benchmark decontamination: documents that contain an item of a benchmark, exactly or nearly.

For an item of L words, each window of L words of a document is compared with it. Both are sets of
word triples (of all words, for an item of one or two), weighted by the length of their words; the fingerprint counts a triple as often as it occurs.
A window's 64-bit SimHash comes from prefix sums over the document. A multi-index finds
the items near a window: each fingerprint falls into BLOCKS bytes, and of two that differ in at most RADIUS
bits at least one byte differs in at most RADIUS // BLOCKS; a table per byte has all items within that
many bits, so that no item within the radius is missed. The weighted Jaccard similarity of each
such pair decides.

Windows are only built where they can matter, which loses nothing: a window can't reach
`threshold` unless the document has triples of the item that make up that share of the item's weight. That test is what selects: at a
similarity of `threshold` fingerprints differ in 20 of 64 bits on average, so that the radius has to be wide, and the multi-index
at that radius lets most windows of such documents through to the distance, which a fifth of unrelated windows passes.

The benchmark is held by each worker up to `side_bytes` of text, which its indexes make some sixty times as large; a larger one is gone through in slices.

Defined cases: null or wordless texts and items match nothing. Very long texts are read whole, SPAN windows at a time. A document that is shorter than
an item is one window. Of equally similar windows the first counts. Repeated rows
each give their own result; ids may be null; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.llm.common import id_text, keep_rows, map_arrow, table, words

#: Least weighted Jaccard similarity of a window and an item; bits in which their fingerprints may differ; bytes of the index.
THRESHOLD, RADIUS, BLOCKS = 0.4, 28, 8
SHINGLE, SPAN = 3, 8192
#: Bytes of items' text that a worker holds at a time.
SIDE_BYTES = 4 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MASK_SHIFT = np.uint64(64 - 20)


def weight(shingle: tuple[str, ...]) -> int:
    return sum(min(len(w), 8) for w in shingle)


def shingles(ws: list[str], k: int) -> list[tuple[str, ...]]:
    return list(zip(*(ws[i:] for i in range(k))))


def vectors(grams: list[tuple[str, ...]]) -> np.ndarray:
    """A row of 64 signed weights for each shingle."""
    raw = np.array([xxhash.xxh3_64_intdigest(" ".join(g).encode("utf-8", "replace")) for g in grams], np.uint64)
    bits = np.unpackbits(raw.byteswap().view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return (2 * bits - 1) * np.fromiter(map(weight, grams), np.int64, len(grams))[:, None]


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


def similarity(a: set[tuple[str, ...]], b: set[tuple[str, ...]]) -> float:
    union = sum(map(weight, a | b))
    return sum(map(weight, a & b)) / union if union else 0.0


class Benchmark:
    """Items with the indexes that one pass over documents needs."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float, radius: int) -> None:
        self.threshold, self.radius = threshold, radius
        self.items = [(i, ws) for i, t in items if (ws := words(t))]
        self.k = [min(SHINGLE, len(ws)) for _, ws in self.items]
        grams = [shingles(ws, k) for (_, ws), k in zip(self.items, self.k)]
        self.sets = [set(g) for g in grams]
        self.total = np.array([sum(map(weight, s)) for s in self.sets], np.int64)
        self.prints = np.array([simhash(vectors(g).sum(axis=0, keepdims=True))[0] for g in grams], np.uint64)
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, (_, ws) in enumerate(self.items):
            groups[self.k[n], len(ws)].append(n)
        self.groups = dict(groups)
        self.lookup: dict[int, tuple] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lookup": None}  # its hashes are those of one process

    def _hashes(self, ws: np.ndarray, k: int) -> np.ndarray:
        n = len(ws) - k + 1
        out = ws[:n] * _MIX[0]
        for i in range(1, k):
            out = out + ws[i : n + i] * _MIX[i]
        return out ^ (out >> np.uint64(29))

    def _index(self) -> dict[int, tuple]:
        """For each length of shingles: a bitmap of hashes, the sorted hashes, and for each the items that have it and its weight."""
        where: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        weights: dict[tuple[int, int], int] = {}
        for n, s in enumerate(self.sets):
            for g in s:
                h = int(self._hashes(np.array([hash(w) for w in g], np.int64).view(np.uint64), self.k[n])[0])
                where[self.k[n]][h].append(n)
                weights[self.k[n], h] = weight(g)
        out = {}
        for k, found in where.items():
            keys = np.sort(np.array(list(found), np.uint64))
            bitmap = np.zeros(1 << 20, bool)
            bitmap[keys >> _MASK_SHIFT] = True
            out[k] = bitmap, keys, [np.array(found[int(h)]) for h in keys], [weights[k, int(h)] for h in keys]
        return out

    def possible(self, ws: list[str]) -> np.ndarray:
        """Items that a window of the document can reach."""
        if self.lookup is None:
            self.lookup = self._index()
        raw = np.fromiter(map(hash, ws), np.int64, len(ws)).view(np.uint64)
        shared = np.zeros(len(self.items), np.int64)
        for k, (bitmap, keys, items, weights) in self.lookup.items():
            if len(ws) < k:
                continue
            h = self._hashes(raw, k)
            h = np.unique(h[bitmap[h >> _MASK_SHIFT]])
            at = np.searchsorted(keys, h)
            for i in at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h)].tolist():
                shared[items[i]] += weights[i]
        return np.flatnonzero((shared > 0) & (shared >= self.threshold * self.total))

    def near(self, prints: np.ndarray, items: list[int]) -> np.ndarray:
        """Whether each fingerprint is within the radius of each item: candidates from the multi-index, then the distance."""
        own, width = self.prints[items], 64 // BLOCKS
        candidate = np.zeros((len(prints), len(items)), bool)
        values = np.arange(1 << width, dtype=np.uint64)
        for b in range(BLOCKS):
            part = lambda x, b=b: (x >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
            within = np.bitwise_count(values[:, None] ^ part(own)[None, :]) <= self.radius // BLOCKS
            candidate |= within[part(prints).astype(np.int64)]
        i, j = np.nonzero(candidate)
        candidate[i, j] = np.bitwise_count(prints[i] ^ own[j]) <= self.radius
        return candidate

    def matches(self, text: str | None) -> Iterator[tuple[int | None, float, int, int]]:
        """(item, similarity, first and last word + 1 of the best window) for each item that the text contains."""
        ws = words(text)
        if not ws or not self.items:
            return
        wanted = set(self.possible(ws).tolist())
        for (k, length), members in self.groups.items() if wanted else ():
            items = [n for n in members if n in wanted]
            if not items or len(ws) < k:
                continue
            grams = shingles(ws, k)
            size = min(length - k + 1, len(grams))
            best: dict[int, tuple[float, int]] = {}
            for at in range(0, len(grams) - size + 1, SPAN):
                part = grams[at : at + SPAN + size - 1]
                sums = np.zeros((len(part) + 1, 64), np.int64)
                np.cumsum(vectors(part), axis=0, out=sums[1:])
                for i, j in zip(*np.nonzero(self.near(simhash(sums[size:] - sums[:-size]), items))):
                    s = similarity(set(part[i : i + size]), self.sets[items[j]])
                    if s >= self.threshold and s > best.get(j, (0.0, 0))[0]:
                        best[j] = s, at + int(i)
            for j, (s, start) in sorted(best.items()):
                yield self.items[items[j]][0], round(s, 6), start, start + size + k - 1


def slices(items: DataFrame, id_col: str, text_col: str, threshold: float, radius: int, side_bytes: int) -> Iterator[Benchmark]:
    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    n = (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // side_bytes + 1
    for i in range(n):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else own
        yield Benchmark([(r.item_id, r.text) for r in part.collect()], threshold, radius)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word) for each document and item that it contains."""
    out = None
    for bench in slices(items, item_col, item_text_col, threshold, radius, side_bytes):

        def step(batch: pa.RecordBatch, bench: Benchmark = bench) -> dict:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in bench.matches(t)]
            return dict(zip(("doc_id", "item_id", "similarity", "first_word", "end_word"), zip(*rows) if rows else [[]] * 5))

        found = map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, item_id long, similarity double, first_word int, end_word int")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """docs without the rows that contain an item."""
    for bench in slices(items, item_col, item_text_col, threshold, radius, side_bytes):
        docs = keep_rows(docs, lambda batch, bench=bench: [next(bench.matches(t), None) is None for t in batch.column(text_col).to_pylist()])
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
