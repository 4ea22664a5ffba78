"""Language identification of code-switched text by a linear-chain conditional random field.

Each word of a document is a node; its label is a language. Node scores come from affixes, character
bigrams and trigrams of the whole word, the word itself, lexicons of each language's most frequent words, and
shape; they are hashed into a table of weights. A matrix of transitions is learned with them, free of any
normalisation. Forward-backward over the whole document gives each word's distribution.

The field is fitted on the driver, on at most `train_docs` labelled documents of each language, those with the least hash of the
id, each used whole. The label is the document's language column; sentences that a word-frequency model
gives to another language are left out. Sequences that switch are joined from sentences of several languages and begin anywhere in the first.

For forward-backward without a loop over words, a document is cut into blocks; the products of each
block's matrices are taken for all blocks at once, carried over from block to block, and then refined
within blocks. The result is the exact one.

Defined cases: a null, empty or wordless text has a null language, confidence 0 and no runs. Very long texts and words are read whole. Of languages
with the same mass in a document, or of the same probability for a word, the first in the alphabet counts. Without labelled
documents there are no languages, and every result is like that; an empty table gives an empty result. Repeated rows are
labelled each; ids may be null. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objectlake.llm.common import id_text, table, words, workers

#: Most labelled documents of each language that the field is fitted on.
TRAIN_DOCS = 250
HASH, LEXICON = 1 << 15, 150
SEQUENCE, SEQUENCES, EPOCHS, BLOCK, REMEMBER = 32, 2000, 5, 32, 300_000
_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def _hashed(salt: int, *cols: np.ndarray) -> np.ndarray:
    h = np.full(len(cols[0]), salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in cols:
        h = (h ^ c.astype(np.uint64)) * _P[0] + (h >> np.uint64(29))
    return ((h ^ (h >> np.uint64(17))) & np.uint64(HASH - 1)).astype(np.int32)


def word_features(ws: list[str], lexicon: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words, in parts: the places in `ws`, in their order, and a feature of each; every part has all features of one kind of some words."""
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // 400_000)) + 1  # characters at a time; a word is never parted
    for at in np.split(np.arange(len(ws)), cuts):
        if not len(at):
            continue
        n = size[at]
        chars = np.frombuffer("".join([ws[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        begin = np.cumsum(n) - n
        # a mark before and after each word
        c = np.empty(len(chars) + 2 * len(at), np.uint64)
        word = np.repeat(np.arange(len(at)), n + 2)
        first = begin + 2 * np.arange(len(at))
        c[first], c[first + n + 1] = 2, 3
        inner = np.ones(len(c), bool)
        inner[first] = inner[first + n + 1] = False
        c[inner] = chars
        for k in range(1, 4):
            some = np.flatnonzero(n >= k)
            yield at[some], _hashed(k, *(c[first[some] + 1 + j] for j in range(k)))
            yield at[some], _hashed(10 + k, *(c[first[some] + n[some] - k + 1 + j] for j in range(k)))
        for k, salt in ((2, 20), (3, 21)):
            p = np.flatnonzero(word[: len(c) - k + 1] == word[k - 1 :])
            yield at[word[p]], _hashed(salt, *(c[p + j] for j in range(k)))
        known = np.fromiter((lexicon.get(ws[i], 0) for i in at), np.int64, len(at))
        some = np.flatnonzero(known)
        yield at[some], _hashed(30, known[some])
        # the whole word: a polynomial of its characters, modulo 2**64
        power = np.cumprod(np.full(int(n.max()) + 1, _P[3] * _P[1] | np.uint64(1), np.uint64))
        nth = np.arange(len(chars)) - np.repeat(begin, n)
        whole = np.add.reduceat(chars * power[nth], begin)
        yield at, _hashed(31, whole ^ (whole >> np.uint64(32)), n)
        yield at, _hashed(32, np.minimum(n, 12))
        yield at, _hashed(33, np.logical_or.reduceat(chars > 127, begin))
        yield at, _hashed(34, np.logical_or.reduceat((chars >= 48) & (chars <= 57), begin))


def word_scores(parts: Iterator[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int) -> np.ndarray:
    """The sum of the weights of each word's features."""
    out = np.zeros((n, weights.shape[1]), weights.dtype)
    for at, feats in parts:
        if len(at):
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            out[at[first]] += np.add.reduceat(weights[feats], first, axis=0)
    return out


class Field:
    def __init__(self, languages: list[str], lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.languages, self.lexicon, self.weights, self.moves = languages, lexicon, weights, moves
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": {}, "scores": self.scores[:0]}

    def emissions(self, ws: list[str]) -> np.ndarray:
        out = word_scores(word_features(ws, self.lexicon), self.weights, len(ws))
        return np.exp(out - out.max(axis=1, keepdims=True, initial=-np.inf))

    def look_up(self, documents: list[list[str]]) -> np.ndarray:
        """The row of `scores` of each word."""
        known = self.rows
        new = list(dict.fromkeys(w for ws in documents for w in ws if w not in known))
        if len(known) + len(new) > REMEMBER:
            known, self.scores = {}, self.scores[:0]
            new = list(dict.fromkeys(w for ws in documents for w in ws))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.scores = np.concatenate([self.scores, self.emissions(new)])
        self.rows = known
        return np.fromiter((known[w] for ws in documents for w in ws), np.int64, sum(map(len, documents)))

    def marginals(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The distribution of each word's label; sizes: words of each document, all above 0."""
        k, T = len(self.languages), self.moves.astype(np.float32)
        blocks = -(-sizes // BLOCK)
        total = int(blocks.sum())
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        n = np.minimum(BLOCK, sizes[doc] - nth * BLOCK)
        first = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        order = np.argsort(-n, kind="stable")  # longest first, so that step t works on the first rows only
        n, first, opens = n[order], first[order], (nth == 0)[order]
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        live = [int(np.searchsorted(-n, -t, side="left")) for t in range(BLOCK)]
        M = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
        for t in range(BLOCK):
            m = live[t]
            if not m:
                break
            step = (M[:m].reshape(-1, k) @ T).reshape(m, k, k)
            if not t:  # no transition leads to the first word of a document
                step[opens[:m]] = np.eye(k, dtype=np.float32)
            M[:m] = step * self.scores[rows[first[:m] + t]][:, None, :]
            if t % 4 == 3:
                M[:m] /= M[:m].max(axis=(1, 2), keepdims=True)
        into, out = np.full((total, k), 1 / k, np.float32), np.ones((total, k), np.float32)
        longest = np.argsort(-blocks, kind="stable")
        start = (np.cumsum(blocks) - blocks)[longest]
        count = blocks[longest]
        for j in range(1, int(count[0])):
            m = int(np.searchsorted(-count, -j, side="left"))
            p, q = place[start[:m] + j - 1], place[start[:m] + j]
            a = np.einsum("bi,bij->bj", into[p], M[p])
            into[q] = a / a.sum(axis=1, keepdims=True)
        for j in range(int(count[0]) - 1, 0, -1):
            m = int(np.searchsorted(-count, -j, side="left"))
            p, q = place[start[:m] + j - 1], place[start[:m] + j]
            b = np.einsum("bij,bj->bi", M[q], out[q])
            out[p] = b / b.max(axis=1, keepdims=True)
        result = np.empty((len(rows), k), np.float32)
        a = into
        for t in range(BLOCK):
            m = live[t]
            if not m:
                break
            x = a[:m] @ T
            if not t:
                x[opens[:m]] = 1
            x *= self.scores[rows[first[:m] + t]]
            a = x / x.sum(axis=1, keepdims=True)
            result[first[:m] + t] = a
        b = out
        for t in range(BLOCK - 1, -1, -1):
            m = live[t]
            if not m:
                continue
            at = first[:m] + t
            g = result[at] * b[:m]
            result[at] = g / g.sum(axis=1, keepdims=True)
            x = (self.scores[rows[at]] * b[:m]) @ T.T
            b[:m] = x / x.max(axis=1, keepdims=True)
        return result

    def label(self, texts: list[str | None]) -> dict[str, pa.Array]:
        documents = [words(t) for t in texts] if self.languages else [[] for _ in texts]
        sizes = np.array([len(d) for d in documents])
        some = np.flatnonzero(sizes)
        lang, confidence, switches, offsets = np.full(len(texts), None, object), np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = ends = codes = np.zeros(0, np.int32)
        p = np.zeros(0)
        if len(some):
            n = sizes[some]
            marg = self.marginals(self.look_up([documents[i] for i in some]), n)
            begin = np.cumsum(n) - n
            mass = np.add.reduceat(marg.astype(float), begin, axis=0) / n[:, None]
            best = mass.argmax(axis=1)
            lang[some] = [self.languages[b] for b in best]
            confidence[some] = np.round(mass[np.arange(len(some)), best], 4)
            labels = marg.argmax(axis=1)
            change = np.r_[True, labels[1:] != labels[:-1]]
            change[begin] = True
            at = np.flatnonzero(change)
            codes = labels[at]
            owner = np.searchsorted(begin, at, side="right") - 1
            starts, ends = at - begin[owner], np.r_[at[1:], len(labels)] - begin[owner]
            p = np.round(np.add.reduceat(marg.max(axis=1).astype(float), at) / (ends - starts), 4)
            runs = np.zeros(len(texts), np.int64)
            runs[some] = np.bincount(owner, minlength=len(some))
            switches = np.maximum(runs - 1, 0)
            offsets[1:] = np.cumsum(runs)
        names = pa.array(self.languages or [""], pa.string()).take(pa.array(codes, pa.int64()))
        inner = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), names, pa.array(p, pa.float64())], names=["start", "end", "lang", "p"])
        return {
            "lang": pa.array(lang.tolist(), pa.string()),
            "confidence": pa.array(confidence),
            "n_words": pa.array(sizes, pa.int32()),
            "n_switches": pa.array(switches, pa.int32()),
            "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner),
        }


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Field:
    """A field from (language, text) pairs."""
    languages = sorted({lang for lang, _ in samples})
    index = {x: n for n, x in enumerate(languages)}
    k = len(languages)
    sentences = [(index[lang], ws) for lang, text in samples for s in re.split(r"[.!?\n]+", text) if (ws := words(s))]
    counts = [Counter() for _ in languages]
    for y, ws in sentences:
        counts[y].update(ws)
    totals = [sum(c.values()) + len(c) + 1 for c in counts]
    likely = {w: np.log([(c[w] + 0.5) / t for c, t in zip(counts, totals)]) for w in set().union(*counts)} if counts else {}
    pool: dict[int, list[list[str]]] = defaultdict(list)
    for y, ws in sentences:
        if int(np.argmax(sum(likely[w] for w in ws))) == y:
            pool[y].append(ws)
    lexicon = {}
    for n, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << n  # a word of several lexicons is a feature of its own
    rng = np.random.default_rng(seed)
    present = sorted(pool)
    vocabulary: dict[str, int] = {}
    X, Y = np.zeros((SEQUENCES, SEQUENCE), np.int64), np.zeros((SEQUENCES, SEQUENCE), np.int64)
    for i in range(SEQUENCES if present else 0):
        ws, ys, skip = [], [], None
        while len(ws) < SEQUENCE + (skip or 0):
            y = int(rng.choice(present))
            for _ in range(int(rng.integers(1, 4))):
                s = pool[y][int(rng.integers(len(pool[y])))]
                ws += s
                ys += [y] * len(s)
                skip = int(rng.integers(len(s))) if skip is None else skip
        X[i], Y[i] = [vocabulary.setdefault(w, len(vocabulary)) for w in ws[skip : skip + SEQUENCE]], ys[skip : skip + SEQUENCE]
    field = Field(languages, lexicon, np.zeros((HASH, k), np.float32), np.full((k, k), 1 / max(k, 1)))
    if not present:
        return field
    groups = list(word_features(list(vocabulary), lexicon))
    W, M = np.zeros((HASH, k)), 2 * np.eye(k)
    sW, sM = np.full_like(W, 1e-3), np.full_like(M, 1e-3)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(SEQUENCES), 8):
            E = word_scores(groups, W, len(vocabulary))
            e = np.exp(E - E.max(axis=1, keepdims=True))[X[part]]
            T = np.exp(M - M.max())
            a, b = np.empty_like(e), np.ones_like(e)
            before = np.ones((len(part), k))
            for t in range(SEQUENCE):
                before = (before @ T if t else before) * e[:, t]
                before /= before.sum(axis=1, keepdims=True)
                a[:, t] = before
            for t in range(SEQUENCE - 1, 0, -1):
                x = (e[:, t] * b[:, t]) @ T.T
                b[:, t - 1] = x / x.sum(axis=1, keepdims=True)
            g = a * b
            g /= g.sum(axis=2, keepdims=True)
            xi = a[:, :-1, :, None] * T * (e[:, 1:] * b[:, 1:])[:, :, None, :]
            xi = (xi / xi.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
            seen = np.zeros((k, k))
            np.add.at(seen, (Y[part][:, :-1].ravel(), Y[part][:, 1:].ravel()), 1)
            left = np.eye(k)[Y[part]] - g
            by_word = np.stack([np.bincount(X[part].ravel(), left[..., j].ravel(), len(vocabulary)) for j in range(k)], axis=1)
            grad = -1e-2 * W
            for at, feats in groups:
                for j in range(k):
                    grad[:, j] += np.bincount(feats, by_word[at, j], HASH)
            move = seen - xi - 1e-2 * M
            sW += grad * grad
            sM += move * move
            W += 0.2 * grad / np.sqrt(sW)
            M += 0.4 * move / np.sqrt(sM)
    field.weights, field.moves = W.astype(np.float32), np.exp(M - M.max())
    return field


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Field:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    picked = own.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("nth") <= train_docs)
    rows = own.join(F.broadcast(picked.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).distinct().collect()  # train_docs of each language
    return fit([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))])


def labelled(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, confidence, n_words, n_switches, runs) for each document; runs: first and end word, language and mean probability."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = field.label(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.values()], names=["doc_id", *out])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang string, confidence double, n_words int, n_switches int, runs array<struct<start: int, end: int, lang: string, p: double>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return labelled(docs, train(docs))
