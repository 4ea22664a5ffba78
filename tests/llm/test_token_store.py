"""Compressed token ids: exact round trips, single documents, and the use of the dictionary."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from objectlake.llm import token_store as S
from objectlake.llm.bpe import VOCABULARY
from tests.llm.helpers import docs, odd, prose


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def corpus(n=200):
    return [(i, prose(i, 20 + i % 60)) for i in range(n)]


def test_round_trip(spark, other):
    data = docs(spark, odd(*((100 + i, t) for i, t in corpus())))
    dictionary = S.train(data)
    assert dictionary
    texts = {}
    for r in data.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got = S.frames(data, dictionary).collect()
    assert len(got) == data.count()
    for r in got:
        if r.frame is None:
            assert None in texts[r.doc_id]
            assert (r.length, r.n_tokens) == (0, None)
            continue
        ids = S.ids(bytes(r.frame), dictionary)
        assert len(ids) == r.n_tokens
        assert r.length == len(r.frame)
        assert r.dictionary == S.dictionary_hash(dictionary)
        if r.doc_id and len(texts[r.doc_id][0]) < 10_000:
            assert ids.tolist() == other.encode(texts[r.doc_id][0], add_special_tokens=False).ids


def test_offsets_follow_each_other(spark):
    data = docs(spark, corpus()).repartition(3)
    got = S.frames(data, S.train(data)).collect()
    for shard in {r.shard for r in got}:
        at = 0
        for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_store(spark, tmp_path, other):
    data = docs(spark, [*corpus(60), (900, ""), (901, None)]).repartition(3)
    folder = str(tmp_path / "store")
    name = S.write_store(data, folder)
    for i in (0, 17, 59):
        assert S.read_document(folder, i).tolist() == other.encode(prose(i, 20 + i % 60), add_special_tokens=False).ids
    assert S.read_document(folder, 900).tolist() == []
    assert len(name) == 64
    (tmp_path / "store" / "dictionary").write_bytes(b"another")
    with pytest.raises(ValueError, match="another dictionary"):
        S.read_document(folder, 0)


def test_dictionary_helps_short_documents(spark):
    data = docs(spark, corpus(600))
    sum_of = lambda d: sum(r.length for r in S.frames(data, d).collect())
    assert sum_of(S.train(data)) < 0.9 * sum_of(b"")


def test_no_documents_to_train_on(spark, other):
    data = docs(spark, [(1, "a text"), (2, None)])
    assert S.train(data) == b""
    assert S.train(data.limit(0)) == b""
    got = {r.doc_id: r for r in S.frames(data, b"").collect()}
    assert got[1].dictionary == ""
    assert S.ids(bytes(got[1].frame), b"").tolist() == other.encode("a text", add_special_tokens=False).ids
    assert S.frames(data.limit(0), b"").count() == 0


def test_same_ids_whatever_the_partitions(spark):
    data = docs(spark, corpus())
    found = []
    for part in (data.repartition(7), data.coalesce(1)):
        dictionary = S.train(part)
        found.append(sorted((r.doc_id, S.ids(bytes(r.frame), dictionary).tolist()) for r in S.frames(part, dictionary).collect()))
    assert found[0] == found[1]


def test_all_documents_count(spark):
    """Dictionaries of many stretches are merged, in rounds, and what only the last documents have is in it as well."""
    data = docs(spark, [*corpus(3000), *((5000 + i, f"zyxwvut qqponml kjjihgf {i} edcbazz yyxxwwv " * 2) for i in range(2000))]).coalesce(2)
    rounds, size = S.train(data, stretch=10_000), lambda d: sum(r.length for r in S.frames(data.where("doc_id >= 5000"), d).collect())
    assert rounds == S.train(data, stretch=10_000)
    assert size(rounds) < 0.8 * size(b"")
    assert size(S.train(data)) < 0.7 * size(b"")
