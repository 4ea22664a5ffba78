"""The pipeline against a plain version of each stage, each on its own input."""

from __future__ import annotations

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from objectlake.llm import bpe, pii, quality
from objectlake.llm.common import table
from tests.conftest import SF_DIR
from tests.llm.test_decontaminate import brute
from tests.llm import helpers
from tests.llm.helpers import changed, odd, prose
from tests.llm.test_near_dedup import groups


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and comes out of the last."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, SF_DIR, "documents"), []
    out.append(docs)
    for n, (_, f) in enumerate(C.STAGES):
        f(spark, docs, SF_DIR).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def ids(rows):
    return [r.doc_id for r in rows]


def test_columns(stages):
    assert [c for c, _ in stages[:-1]] == [stages[0][0]] * 5
    assert stages[-1][0] == ["doc_id", "n_tokens", "tokens", "text"]


def test_quality(spark, stages):
    model = quality.train(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    want = [r.doc_id for r in stages[0][1] if quality.scores(model, [r.text])[0] >= quality.THRESHOLD]
    assert sorted(ids(stages[1][1])) == sorted(want)


def test_near_duplicates(stages):
    keep = {i for i, k in groups([(r.doc_id, r.text) for r in stages[1][1]]).items() if i == k}
    assert sorted(ids(stages[2][1])) == sorted(keep)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    want = [r.doc_id for r in stages[2][1] if next(brute(r.text, items), None) is None]
    assert sorted(ids(stages[3][1])) == sorted(want)


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages[3][1]}
    assert sorted(ids(stages[4][1])) == sorted(before)
    for r in stages[4][1]:
        assert r.text == pii.redact(before[r.doc_id], pii.find(before[r.doc_id]))
        assert r.n_chars == len(r.text)


def test_tokens(stages):
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    before = {r.doc_id: r.text for r in stages[4][1]}
    assert sorted(ids(stages[5][1])) == sorted(before)
    for r in stages[5][1]:
        assert r.text == before[r.doc_id]
        assert r.tokens == t.encode(r.text, add_special_tokens=False).ids


def test_run(spark, stages):
    got = C.run(spark, SF_DIR)
    assert sorted(ids(got.collect())) == sorted(ids(stages[-1][1]))


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with all that can be odd: nulls, empty and very long texts, repeated rows, columns with clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    copies = [(n, prose(3, 80)) for n in (40, 41, 41, None)] + [(n, changed(prose(3, 80), n, 0.03)) for n in range(50, 60)]
    data = odd((20, f"{prose(7, 60)} mail a.b@c.org"), (21, f"{prose(8, 40)} {prose(1000, 30)} {prose(9, 40)}"), *copies)
    helpers.docs(spark, data).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(1000, 30)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), data


def test_odd_tables(spark, odd_dir):
    """Without labels nothing is rejected: of copies the least id stays, what has an item goes, an address is redacted, the rest goes through."""
    folder, data = odd_dir
    got = sorted(((r.doc_id, r.text) for r in C.run(spark, folder).collect()), key=repr)
    gone = {i for i, k in groups([(n, t) for n, (_, t) in enumerate(data)]).items() if i != k}
    want = [(i, t if t is None else t.replace("a.b@c.org", "[EMAIL]")) for n, (i, t) in enumerate(data) if n not in gone and i != 21]
    assert got == sorted(want, key=repr)
    assert sum(i in range(40, 60) for i, _ in got) == 1


def test_empty_tables(spark, odd_dir, tmp_path):
    folder, _ = odd_dir
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = C.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "tokens", "text"]
    assert out.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2:3].isdigit()} == set(range(1, 11))
