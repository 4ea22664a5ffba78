"""Language identification: held-out accuracy, code-switched texts, exact marginals, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from objectlake.llm import language as L
from objectlake.llm.common import table, words
from tests.llm.helpers import docs, odd, rows

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def parts(spark):
    """Half of the documents to learn from, and the other half."""
    own = table(spark, DATA, "documents")
    return own.where("doc_id % 2 = 0").cache(), own.where("doc_id % 2 = 1").cache()


@pytest.fixture(scope="module")
def field(parts):
    return L.train(parts[0])


def test_held_out_accuracy(parts, field):
    found = {r.doc_id: r for r in L.labelled(parts[1], field).collect()}
    real = [r for r in parts[1].collect() if len(words(r.text)) >= 8]
    right = sum(found[r.doc_id].lang == r.lang for r in real)
    assert right >= 0.93 * len(real)


def test_code_switched_words(parts, field):
    """Words of sentences of two languages, joined."""
    held = parts[1].collect()
    by = {lang: [r.text for r in held if r.lang == lang and 15 <= len(words(r.text)) <= 60] for lang in field.languages}
    right = total = 0
    for a, b in (("en", "de"), ("fr", "es"), ("de", "fr"), ("es", "en")):
        for x, y in list(zip(by[a], by[b]))[:8]:
            nx, ny = len(words(x)), len(words(y))
            runs = field.label([f"{x} {y}"])["runs"][0].as_py()
            truth = [a] * nx + [b] * ny
            got = [r["lang"] for r in runs for _ in range(r["end"] - r["start"])]
            assert len(got) == nx + ny
            right += sum(p == q for p, q in zip(got, truth))
            total += nx + ny
    assert total > 300
    assert right >= 0.85 * total


@pytest.mark.parametrize("sizes", [[1], [5, 1, 200], [32, 33, 31, 64, 65], [1000]])
def test_marginals_are_exact(sizes):
    """Blocks give the same as forward-backward word by word."""
    rng = np.random.default_rng(sum(sizes))
    k = 3
    field = L.Field(list("abc"), {}, np.zeros((L.HASH, k), np.float32), rng.dirichlet(np.ones(k), k))
    field.scores = rng.random((50, k)).astype(np.float32) + 0.01
    ids = rng.integers(0, 50, sum(sizes))
    got = field.marginals(ids, np.array(sizes))
    at = 0
    for n in sizes:
        e, T = field.scores[ids[at : at + n]].astype(float), field.moves
        a, b = np.zeros((n, k)), np.ones((n, k))
        before = np.ones(k)
        for t in range(n):
            before = (before @ T if t else before) * e[t]
            before /= before.sum()
            a[t] = before
        for t in range(n - 1, 0, -1):
            b[t - 1] = T @ (e[t] * b[t])
            b[t - 1] /= b[t - 1].sum()
        g = a * b
        assert np.allclose(got[at : at + n], g / g.sum(axis=1, keepdims=True), atol=2e-4)
        at += n


def test_same_as_all_labellings(field):
    """The distribution of each word, from the weights of all sequences of labels of a short text."""
    from itertools import product

    ws = words("the house und das Haus et la casa")
    k = len(field.languages)
    e = np.exp(L.word_scores(L.word_features(ws, field.lexicon), field.weights.astype(float), len(ws)))
    want = np.zeros((len(ws), k))
    for labels in product(range(k), repeat=len(ws)):
        p = np.prod([e[t, y] for t, y in enumerate(labels)]) * np.prod([field.moves[a, b] for a, b in zip(labels, labels[1:])])
        want[np.arange(len(ws)), labels] += p
    got = field.marginals(field.look_up([ws]), np.array([len(ws)]))
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def _plain_features(w, lexicon):
    """What word_features hashes, one word at a time; the whole word by its text."""
    c, n, out = [2, *map(ord, w), 3], len(w), []
    for k in range(1, 4):
        if n >= k:
            out += [(k, *c[1 : 1 + k]), (10 + k, *c[n - k + 1 : n + 1])]
    out += [(20, *c[i : i + 2]) for i in range(n + 1)] + [(21, *c[i : i + 3]) for i in range(n)]
    if lexicon.get(w):
        out.append((30, lexicon[w]))
    return [*out, (32, min(n, 12)), (33, int(any(ord(x) > 127 for x in w))), (34, int(any(48 <= ord(x) <= 57 for x in w)))]


def test_features_read_the_whole_word():
    ws = ["a", "straße", "x" * 50 + "y" + "x" * 50, "z9" * 300, "the", "漢字", "q" * 500_000, "end"]
    lexicon = {"the": 5}
    got = {i: [] for i in range(len(ws))}
    for at, feats in L.word_features(ws, lexicon):
        for i, f in zip(at.tolist(), feats.tolist()):
            got[i].append(f)
    for i, w in enumerate(ws):
        if len(w) > 1000:
            assert len(got[i]) == 2 * len(w) + 1 + 6 + 4
            continue
        want = sorted(int(L._hashed(salt, *(np.array([x], np.uint64) for x in rest))[0]) for salt, *rest in _plain_features(w, lexicon))
        left = sorted(got[i])
        for f in want:
            left.remove(f)
        assert len(left) == 1  # the whole word
    # words of the same ends that differ in the middle have different features
    a, b = ("x" * 60 + m + "x" * 60 for m in "yz")
    assert sorted(f for _, fs in L.word_features([a], {}) for f in fs) != sorted(f for _, fs in L.word_features([b], {}) for f in fs)


def test_languages_of_long_texts_only(spark):
    """A language whose labelled documents are all long is one as well."""
    own = docs(spark, [(n, "the house is small. " * 3) for n in range(20)]).unionByName(docs(spark, [(100 + n, "das Haus ist klein und alt. " * 2000) for n in range(5)]).withColumn("lang", F.lit("de")))
    field = L.train(own)
    assert field.languages == ["de", "en"]
    assert field.label(["das Haus ist klein", "the house is small"])["lang"].to_pylist() == ["de", "en"]


def test_transitions_are_learned(field):
    """To stay in a language weighs more than to change it."""
    off = field.moves - np.diag(np.diag(field.moves))
    assert (np.diag(field.moves) > off.max(axis=1)).all()


def test_odd_rows(spark, field):
    found = {r.doc_id: r for r in L.labelled(docs(spark, odd()), field).collect()}
    for n in (1, 2, 3, 4):
        assert (found[n].lang, found[n].confidence, found[n].n_words, found[n].n_switches, list(found[n].runs)) == (None, 0.0, 0, 0, [])
    assert found[6].n_words == 120_000
    assert found[6].runs[-1].end == 120_000
    assert found[7].n_words == 1
    assert len(rows(L.labelled(docs(spark, odd()), field), "doc_id")) == len(odd())


def test_words_remembered_don_t_matter(field, monkeypatch):
    texts = ["the house is small and old", "das Haus ist klein und alt", "la maison est petite", "la casa es pequeña y vieja"] * 3
    want = field.label(texts)["lang"].to_pylist()
    monkeypatch.setattr(L, "REMEMBER", 3)
    assert [field.label([t])["lang"][0].as_py() for t in texts] == want


def test_no_labels(spark):
    own = docs(spark, [(1, "some text")])
    nothing = L.train(own.limit(0))
    found = L.labelled(own, nothing).first()
    assert (found.lang, found.confidence) == (None, 0.0)
    assert L.labelled(own.limit(0), nothing).count() == 0


def test_one_language_only(spark):
    own = docs(spark, [(n, f"some text number {n}") for n in range(5)])
    assert {r.lang for r in L.labelled(own, L.train(own)).collect()} == {"en"}
