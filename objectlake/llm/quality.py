"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes FEATURES, shares and logarithms of counts over its whole text. The model is fitted on
the driver: features are cut into at most BINS quantile bins; rounds of boosting go through the features
in turn, each time fitting a tree of a few leaves on the gradient of the log loss, and add its
leaf values to the feature's table of bins. The pairs of features whose grids then explain most of
what is left get tables of their own, boosted in the same way with trees of depth two. A score is the
intercept plus one table entry for each feature and pair, added up by column for whole batches.

The model is fitted on at most `train_rows` labelled documents, those with the least hash of
the id; everything else covers all rows. A document's label is the least of its labels.

Defined cases: a null, empty or blank text scores 0 and is not kept. Very long texts are read whole. A score that equals the threshold is kept;
of splits with the same gain the first counts. Without labels of both kinds there is
no model: scores are null and all rows are kept; an empty table gives an empty result. Repeated rows are scored each; ids may be
null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.llm.common import id_text, keep_rows, least, map_arrow, table

#: Most labelled documents that the model is fitted on; least score that is kept.
TRAIN_ROWS, THRESHOLD = 6000, 0.5
BINS, ROUNDS, RATE, PAIRS, GRID = 32, 120, 0.15, 6, 8

FEATURES = ("log_words", "mean_word", "distinct", "top_word", "upper", "digits", "symbols", "bangs", "stops", "commas", "lines", "repeated_lines", "function_words", "long_words")
_FUNCTION = frozenset("the of and to in a is that it for was with as on be are this by an or from at not der die und das ist nicht mit den von zu ein eine im für auf sich le la les de des et un une en est que pour dans du qui sur au par el los las y es por con para una del se no su".split())
_CLASS = np.zeros(256, np.int8)  # 0: other letters
for _n, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@|<>{}[]~^_=+\\/`", "!?", ".", ",;:", "\n", " \t\r"), 1):
    _CLASS[[ord(c) for c in _chars]] = _n


def features(text: str | None) -> list[float] | None:
    """The features of a text; None without any word."""
    ws = text.split() if text else []
    if not ws:
        return None
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    _, upper, digits, symbols, bangs, stops, commas, _, _ = np.bincount(_CLASS[raw], minlength=9).tolist()
    counts, n, size = Counter(ws), len(ws), len(text)
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n),
        (size - n + 1) / n,
        len(counts) / n,
        max(counts.values()) / n,
        upper / size,
        digits / size,
        symbols / size,
        bangs / n,
        stops / n,
        commas / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(counts.get, _FUNCTION & counts.keys())) / n,
        sum(c for w, c in counts.items() if len(w) > 16) / n,
    ]


class Model:
    """intercept, cuts: the bins' upper edges by feature, single: a table by feature, pairs: {(i, j): table}."""

    def __init__(self, intercept: float, cuts: list[np.ndarray], single: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray], coarse: list[np.ndarray]) -> None:
        self.intercept, self.cuts, self.single, self.pairs, self.coarse = intercept, cuts, single, pairs, coarse

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)]
        total = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.single):
            total += t[b]
        for (i, j), t in self.pairs.items():
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values of a tree over ordered bins with sums of gradients and Hessians g and h; best splits first."""
    cuts = [0, len(g)]
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            m = np.arange(a + 1, b)
            if len(m):
                gains = _gain(G[m] - G[a], H[m] - H[a]) + _gain(G[b] - G[m], H[b] - H[m]) - _gain(G[b] - G[a], H[b] - H[a])
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), int(m[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of depth two over a grid, with its gain: one side is split first, then each half by the other."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for m in range(1, len(gg)):
            out, gain = np.zeros_like(gg), 0.0
            for half in (slice(0, m), slice(m, None)):
                t = _tree(gg[half].sum(axis=0), hh[half].sum(axis=0), 2)
                out[half] = t
                gain += float((2 * t * gg[half].sum(axis=0) - t * t * (hh[half].sum(axis=0))).sum())
            if gain > best[0]:
                best = gain, out.T if flip else out
    return best[1], best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    size = [len(c) + 1 for c in cuts]
    coarse = [np.arange(n) * GRID // max(n, GRID) if n > GRID else np.arange(n) for n in size]
    p = y.mean()
    intercept = math.log(p / (1 - p))
    single, f = [np.zeros(n) for n in size], np.full(len(y), intercept)
    for _ in range(ROUNDS):
        for i, b in enumerate(bins):
            q = 1 / (1 + np.exp(-f))
            step = RATE * _tree(np.bincount(b, y - q, size[i]), np.bincount(b, q * (1 - q), size[i]))
            single[i] += step
            f += step[b]
    grids = {}

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        shape = coarse[i][-1] + 1, coarse[j][-1] + 1
        at = grids.setdefault((i, j), coarse[i][bins[i]] * shape[1] + coarse[j][bins[j]])
        return np.bincount(at, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(at, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(len(cuts)), 2), key=lambda ij: (-_tree2(*sums(*ij))[1], ij))
    pairs = {ij: np.zeros((coarse[ij[0]][-1] + 1, coarse[ij[1]][-1] + 1)) for ij in ranked[:PAIRS]}
    for _ in range(ROUNDS // 4):
        for (i, j), t in pairs.items():
            step = RATE * _tree2(*sums(i, j))[0]
            t += step
            f += step[coarse[i][bins[i]], coarse[j][bins[j]]]
    return Model(intercept, cuts, single, pairs, coarse)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the labels; None unless both kinds occur."""
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    found = [(r.doc_id, r.label) for r in least(sample, "doc_id", train_rows)]
    sample = docs.sparkSession.createDataFrame(found, "doc_id long, label int")
    rows = id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")  # as many rows as train_rows

    def step(batch: pa.RecordBatch) -> dict:
        return {"x": [features(t) for t in batch.column("text").to_pylist()], "doc_id": batch.column("doc_id"), "label": batch.column("label")}

    got = map_arrow(rows, step, "doc_id long, label int, x array<double>").where("x is not null").toPandas().sort_values("doc_id", kind="stable")
    if got.label.nunique() < 2:
        return None
    return fit(np.stack(got.x.to_list()), got.label.to_numpy().astype(float))


def scores(model: Model | None, texts: list[str | None]) -> list[float | None]:
    if model is None:
        return [None] * len(texts)
    x = [features(t) for t in texts]
    rows = [r for r in x if r is not None]
    got = iter(np.round(model.score(np.array(rows)), 6).tolist() if rows else [])
    return [0.0 if r is None else next(got) for r in x]


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, keep) for each document."""
    model = train(docs, labels, id_col, text_col, label_col, train_rows)

    def step(batch: pa.RecordBatch) -> dict:
        s = scores(model, batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "score": s, "keep": [x is None or x >= threshold for x in s]}

    return map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows that score below the threshold."""
    model = train(docs, labels, id_col, text_col, label_col, train_rows)
    return keep_rows(docs, lambda batch: [s is None or s >= threshold for s in scores(model, batch.column(text_col).to_pylist())])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
