"""Small exact cases for the operators, with the odd inputs that the driver's tables lack."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from objectlake.functions import codec, vector
from objectlake.functions import text as T
from objectlake.operators import enrich, fulltext, graph, integrity, lifecycle, models, namespace, stats, vectors, versions
from objectlake.plans.predicates import And, Contains, Eq, Or, Related, Semantic, SimilarTo, Tables, compile, compile_wide

EDGE = "src string, pos int, dst string, kind string, strength double, label string"


def one(spark, column, **values):
    """A column's value on a single row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def edges(spark, *rows):
    return spark.createDataFrame([(a, n, b, kind, s, None) for n, (a, b, kind, s) in enumerate(rows)], EDGE)


def objects(spark, names):
    return spark.createDataFrame([(n,) for n in names], "object_id string")


def ids(df, column="object_id"):
    return sorted(r[column] for r in df.collect())


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Hello, world! This is a test.") == ["hello", "world", "this", "is", "a", "test"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


@pytest.mark.parametrize(
    ("raw", "kind"),
    [
        (b"%PDF-1.4", "application/pdf"),
        (b"\x89PNG\r\n\x1a\n", "image/png"),
        (b"hello world", "text/plain"),
        (b'{"key":"value"}', "application/json"),
        (b"GIF89a", "image/gif"),
        (b"\xff\xd8\xff\xe0..", "image/jpeg"),
        (b"PK\x03\x04..", "application/zip"),
        (b"\x1f\x8b\x08\x00", "application/gzip"),
        (b"<?xml version='1.0'?>", "text/xml"),
        (b"---\na: 1", "text/yaml"),
        (b"abc", "application/octet-stream"),
        ("grün und grau".encode(), "application/octet-stream"),
    ],
)
def test_content_type(spark, raw, kind):
    assert one(spark, T.content_type(F.col("d")), d=bytearray(raw)) == kind


def test_cut_at_whole_characters(spark):
    text = "ä" * 150
    got = one(spark, T.cut_bytes(F.col("t"), 199, "..."), t=text)
    assert got == "ä" * 99 + "..."
    assert one(spark, T.cut_bytes(F.col("t"), 300, "..."), t=text) == text


def test_summary_of_nothing(spark):
    assert one(spark, T.summary(F.col("t")), t=" . .") == "(no text)"


def test_hex(spark):
    assert one(spark, T.to_hex(T.from_hex(F.col("t"))), t="aB" * 32) == "ab" * 32
    assert one(spark, T.from_hex(F.col("t")), t="ab" * 31) is None


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1.0), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], -1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 2.0], 0.0)])
def test_cosine(spark, a, b, want):
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-9)


def test_euclidean_of_different_lengths(spark):
    assert one(spark, vector.euclidean(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0]) == float("inf")


def test_nearest(spark):
    rows = spark.createDataFrame([("p1", [1.0, 0.0, 0.0]), ("p2", [0.0, 1.0, 0.0]), ("p3", [0.9, 0.1, 0.0])], "object_id string, vector array<double>")
    assert [r.object_id for r in vectors.search(rows, [1.0, 0.0, 0.0], 2).collect()] == ["p1", "p3"]
    each = vectors.search_all(rows, rows, 1)
    assert {(r.query_id, r.object_id) for r in each.collect()} == {("p1", "p1"), ("p2", "p2"), ("p3", "p3")}


def test_lsh_finds_itself(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"v{i}", rng.normal(size=64).tolist()) for i in range(50)], "object_id string, vector array<double>")
    top = vectors.search_lsh(rows, rows, 1)
    assert {(r.query_id, r.object_id) for r in top.collect()} == {(f"v{i}", f"v{i}") for i in range(50)}


def test_lsh_recall_without_itself(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 64))
    rows = spark.createDataFrame([(f"v{i}", p.tolist()) for i, p in enumerate(points)], "object_id string, vector array<double>")
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    near = np.argsort(-(unit @ unit.T), axis=1)
    want = {(f"v{i}", f"v{j}") for i in range(600) for j in near[i, :11] if i != j}
    got = {(r.query_id, r.object_id) for r in vectors.search_lsh(rows, rows, 11).collect() if r.query_id != r.object_id}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_are_exact(spark, metric):
    """Repeated vectors, a zero vector, another length; null and infinite ones are left out."""
    rng = np.random.default_rng(3)
    data = [(f"v{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)] + [("z", [0.0] * 4), ("s", [1.0, 2.0])]
    rows = spark.createDataFrame(data, "object_id string, vector array<double>")
    odd = rows.union(spark.createDataFrame([("n", None), ("m", [1.0, None, 0.0, 0.0]), ("i", [float("inf"), 0.0, 0.0, 0.0])], rows.schema))
    table = lambda df: sorted((r.query_id, r["rank"], round(r.score, 9)) for r in df.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all blocks meet in one task, whatever their keys hash to
    try:
        assert table(vectors.search_blocks(odd, odd, 7, metric, block_rows=50)) == table(vectors.search_all(rows, rows, 7, metric))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert vectors.search_blocks(rows.limit(0), rows, 3, metric).count() == 0


@pytest.mark.parametrize("name", ["knn_cosine", "knn_euclidean"])
def test_every_fiftieth_vector_is_a_query(spark, name):
    from objectlake.plans import queries
    from tests.conftest import SF_DIR

    ids = {str(r.vec_id) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 50 == 0}
    got = queries.queries()[name](spark, SF_DIR).groupBy("query_id").count().collect()
    assert {r.query_id for r in got} == ids
    assert {r["count"] for r in got} == {10}


def test_quantize(spark):
    v = [-1.0, -0.5, 0.0, 0.5, 1.0]
    back = one(spark, vector.dequantize(vector.quantize(F.col("v"))), v=v)
    assert max(abs(a - b) for a, b in zip(v, back)) < 0.02


@pytest.mark.parametrize(("data", "algo"), [(b"\xaa" * 1000, "rle"), (bytes(i % 256 for i in range(1000)), "delta"), (b"hello world " * 100, "dict"), (bytes(np.random.default_rng(0).integers(0, 256, 1000, np.uint8)), "fast"), (b"short", "none"), (b"", "none")])
def test_codecs(data, algo):
    assert codec.choose(data) == algo
    for a in ("none", "rle", "delta", "dict", "fast"):
        assert codec.decompress(codec.compress(data, a), a) == data


def test_rle_of_long_runs():
    data = b"a" * 255 + b"b" * 256 + b"c" * 510 + b"d"
    assert codec.unrle(codec.rle(data)) == data


def test_embedding():
    assert codec.embed(None) == [0.0] * 128
    assert codec.embed("ab") == [0.0] * 128
    assert np.linalg.norm(codec.embed("some text")) == pytest.approx(1)


def _index(spark):
    texts = spark.createDataFrame([("p1", "hello world"), ("p2", "hello rust"), ("p3", "goodbye world"), ("p4", None), ("p5", "")], "object_id string, text string")
    return fulltext.postings(texts)


def test_all_and_any_terms(spark):
    index = _index(spark)
    assert ids(fulltext.search_all_terms(index, "hello world")) == ["p1"]
    assert ids(fulltext.search_any_term(index, "hello world")) == ["p1", "p2", "p3"]
    assert ids(fulltext.search_all_terms(index, "hello absent")) == []
    assert ids(fulltext.search_all_terms(index, "")) == []
    assert ids(fulltext.search_all_terms(index, "hello hello")) == ["p1", "p2"]
    assert fulltext.vocabulary_size(index).first()[0] == 4


def test_remove_from_index(spark):
    index = fulltext.without(_index(spark), objects(spark, ["p1"]))
    assert ids(fulltext.search_any_term(index, "hello")) == ["p2"]


def test_edges(spark):
    e = edges(spark, ("p1", "p2", "contains", 1.0), ("p1", "p3", "related_to", 0.8))
    assert graph.outgoing(e, ["p1"]).count() == 2
    assert ids(graph.incoming(e, ["p2"]), "src") == ["p1"]
    assert graph.outgoing(e, ["p1"], "related_to").count() == 1
    assert {(r.object_id, r.n_out, r.n_in) for r in graph.degrees(objects(spark, ["p1", "p2", "p3"]), e).collect()} == {("p1", 2, 0), ("p2", 0, 1), ("p3", 0, 1)}


def test_traversal(spark):
    e = edges(spark, ("root", "c1", "contains", 1.0), ("root", "c2", "contains", 1.0))
    o = objects(spark, ["root", "c1", "c2"])
    assert ids(graph.traverse(e, o, ["root"], "contains", 1)) == ["c1", "c2"]
    assert graph.traverse(e, o, ["absent"], None, 1).count() == 0


@pytest.mark.parametrize("depth", [2, 6])
def test_traversal_of_cycle_and_diamond(spark, depth):
    e = edges(spark, *[(a, b, "contains", 1.0) for a, b in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "gone"))])
    found = graph.traverse(e, objects(spark, "abcd"), ["a"], None, depth).collect()
    assert sorted((r.object_id, r.hops) for r in found) == [("a", 3), ("b", 1), ("c", 1), ("d", 2)]


def test_dangling_and_repair(spark):
    e = edges(spark, ("root", "a", "contains", 1.0), ("root", "b", "contains", 1.0), ("a", "b", "depends_on", 1.0), ("a", "missing", "depends_on", 1.0))
    o = objects(spark, ["root", "a", "b"])
    assert ids(graph.dangling(e, o), "dst") == ["missing"]
    assert graph.dangling(graph.repaired(e, o), o).count() == 0
    assert graph.orphans(o, e).count() == 0


def test_report(spark):
    e = edges(spark, ("root", "a", "contains", 1.5), ("root", "x", "contains", 1.0))
    a = spark.createDataFrame([("a", "n"), ("q", "n")], "object_id string, name string")
    r = integrity.report(objects(spark, ["root", "a", "a"]), e, a).first()
    assert (r.n_objects, r.duplicate_ids, r.dangling_edges, r.bad_strength, r.stray_attributes, r.clean) == (3, 1, 1, 1, 1, False)


def test_strong_neighbours(spark):
    e = edges(spark, ("a", "b", "related_to", 0.9), ("a", "c", "related_to", 0.3))
    assert ids(graph.strong_neighbours(e), "dst") == ["b"]


def test_dedup(spark):
    values = spark.createDataFrame([(bytearray(1024),)] * 3, "v binary")
    r = stats.dedup_stats(values, "v").first()
    assert (r.bytes_saved, r.unique_values, r.refs) == (2048, 1, 3)
    assert r.ratio == pytest.approx(2 / 3, abs=1e-6)
    assert stats.dedup_stats(values.limit(0), "v").first().ratio == 0


def test_release(spark):
    changes = lambda *d: spark.createDataFrame([("h", x) for x in d], "hash string, delta int")
    assert stats.live_references(changes(1, 1, -1)).count() == 1
    assert stats.live_references(changes(1, 1, -1, -1)).count() == 0


def _log(spark, letters, seconds=None):
    rows = [(n, c, (seconds or list(range(len(letters))))[n]) for n, c in enumerate(letters)]
    log = spark.createDataFrame(rows, "seq long, object_id string, s long")
    return log.select("seq", "object_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), F.lit("read").alias("access_type"), F.lit(1).alias("user"))


def test_prediction(spark):
    assert [r.next for r in lifecycle.predict(_log(spark, "abcabcab"), above=0).collect()] == ["c"]
    assert lifecycle.patterns(_log(spark, "aaa")).first().freq == 1
    assert lifecycle.patterns(_log(spark, "aaaa")).first().freq == 3


def test_prediction_by_session(spark):
    found = {(r.a, r.b, r.next): r.freq for r in lifecycle.patterns(_log(spark, "abcabcab"), "user").collect()}
    whole = {(r.a, r.b, r.next): r.freq for r in lifecycle.patterns(_log(spark, "abcabcab")).collect()}
    assert found == whole


def test_sequence_numbers(spark):
    log = _log(spark, [str(i) for i in range(200)], [i * 7919 % 200 for i in range(200)]).repartition(5)
    got = [(r.nth, r.s) for r in lifecycle.sequenced(log.withColumn("s", F.col("ts").cast("string")), "ts", "seq").orderBy("nth").collect()]
    assert [n for n, _ in got] == list(range(1, 201))
    assert [s for _, s in got] == sorted(s for _, s in got)


def test_retention(spark):
    policies = spark.createDataFrame([(0, True, 3600, "delete")], "policy_no int, enabled boolean, max_age_s long, action string")
    log = _log(spark, "a", [1])
    assert lifecycle.retention(log, policies, "1970-01-01 00:00:03").count() == 0
    assert lifecycle.retention(log, policies, "1970-01-01 01:23:20").first().action == "delete"


def test_tiers(spark):
    found = lifecycle.tiers(objects(spark, ["a", "b", "c"]), _log(spark, "aa" + "b" * 6))
    assert {r.object_id: r.tier for r in found.collect()} == {"a": "hot", "b": "warm", "c": "cold"}


def test_versions(spark):
    v = spark.createDataFrame([("o", n, f"v{n}") for n in range(1, 6)], "object_id string, version int, content string")
    assert sorted(r.version for r in versions.keep_newest(v, 3).collect()) == [3, 4, 5]
    assert versions.keep_newest(v, 0).count() == 5
    assert versions.as_of(v, 2).first().content == "v2"
    assert versions.diff(v, 1, 2).first().changed is True
    assert sorted(r.version for r in versions.pruned(v, 4).collect()) == [4, 5]


def test_replay(spark):
    log = spark.createDataFrame([(1, "write", "a", "x"), (2, "write", "b", "y"), (3, "write", "c", "z"), (4, "delete", "c", None)], "seq long, op string, object_id string, content string")
    assert ids(versions.replay(log, 1)) == ["b"]
    assert ids(versions.replay(log)) == ["a", "b"]


def test_upsert_and_delete(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in versions.upsert(rows, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in versions.delete(rows, rows.where("k = 'a'"), ["k"]).collect()} == {("b", 2)}


def test_layers(spark):
    layers = spark.createDataFrame([("base", "layer_0", bytearray(1000)), ("base", "layer_1", bytearray(1000)), ("tuned", "layer_0", bytearray(100))], "model_id string, layer string, data binary")
    m = spark.createDataFrame([("base", None), ("tuned", "base")], "model_id string, base_id string")
    found = {(r.model_id, r.layer): len(r.data) for r in models.with_fallback(layers, m).collect()}
    assert found[("tuned", "layer_0")] == 100
    assert found[("tuned", "layer_1")] == 1000
    r = models.savings(layers, m).first()
    assert (r.full_bytes, r.stored_bytes) == (4000, 2100)


def test_session_cache(spark):
    cache = spark.createDataFrame([("m", "s", "l0", "a", 1), ("m", "s", "l1", "b", 2), ("m", "s", "l0", "c", 3)], "model_id string, session_id string, layer string, data string, seq long")
    assert [(r.layer, r.data, r.nth) for r in models.sessions(cache).orderBy("nth").collect()] == [("l0", "c", 1), ("l1", "b", 2)]


def _tree(spark):
    e = edges(spark, ("r", "a", "contains", 1.0), ("a", "b", "contains", 1.0), ("b", "c", "contains", 1.0))
    names = spark.createDataFrame([("r", "root"), ("a", "a"), ("b", "b"), ("c", "c.txt")], "object_id string, name string")
    return e, names


@pytest.mark.parametrize("depth", [3, None])
def test_paths(spark, depth):
    e, names = _tree(spark)
    found = namespace.paths(e, names, objects(spark, ["r"]), depth)
    assert {r.path for r in found.collect()} == {"/root", "/root/a", "/root/a/b", "/root/a/b/c.txt"}
    assert namespace.lookup(found, spark.createDataFrame([("/root//a/./b/c.txt",), ("/root/x",)], "path string")).collect()[0].object_id == "c"


def test_directories(spark):
    e, names = _tree(spark)
    assert ids(namespace.removable(e, objects(spark, ["b", "c"]))) == ["c"]
    assert [r.name for r in namespace.readdir(e, names).where("dir_id = 'a'").orderBy("pos").collect()] == [".", "..", "b"]
    e2, n2 = namespace.moved(e, names, "c", "r", "moved.txt")
    assert {(r.path, r.object_id) for r in namespace.paths(e2, n2, objects(spark, ["r"]), 3).collect()} >= {("/root/moved.txt", "c")}
    e3, n3 = namespace.make(e, names, spark.createDataFrame([("a", "new"), ("a", "b"), ("a", ""), ("a", "x/y")], "dir_id string, name string"))
    assert e3.count() == 4
    assert namespace.unlink(e, objects(spark, ["c"])).count() == 2


def test_splice(spark):
    assert bytes(one(spark, namespace.splice(F.col("d"), 5, b"XY"), d=bytearray(b"abc"))) == b"abc\0\0XY"
    assert bytes(one(spark, namespace.splice(F.col("d"), 1, b"X"), d=bytearray(b"abc"))) == b"aXc"
    assert bytes(one(spark, namespace.truncated(F.col("d"), 5), d=bytearray(b"abc"))) == b"abc\0\0"


def test_enrichment(spark):
    rows = spark.createDataFrame([("p", "report.pdf", bytearray(b"%PDF-1.4\nThis is a finance report about revenue and budget."), None, 0), ("t", "test.txt", bytearray(b"plain text of the test"), None, 1), ("n", None, None, None, 0)], "object_id string, name string, content binary, content_type string, n_edges long")
    got = {r.object_id: r for r in enrich.analyze(rows).collect()}
    assert got["p"].detected_type == "application/pdf"
    assert {"finance", "document"} <= set(got["p"].tags)
    assert got["p"].quality > 0.5
    assert got["t"].language == "en"
    assert got["n"].extracted_text is None
    assert {r.name for r in enrich.enrich(rows).where("object_id = 't'").collect()} >= {"_detected_type", "_extracted_text", "_auto_tags", "_quality"}


def _store(spark):
    a = spark.createDataFrame([("d1", "type", "string", None, None, None, "pdf", None, None, None, None), ("d2", "type", "string", None, None, None, "docx", None, None, None, None), ("d1", "name", "string", None, None, None, "quarterly_report.pdf", None, None, None, None)], "object_id string, name string, tag string, v_bool boolean, v_long long, v_double double, v_string string, v_binary binary, v_vector array<float>, v_ref string, meta struct<ts_ns: long, origin: string, confidence: float, enc_ver: int>")
    e = edges(spark, ("d1", "d2", "references", 1.0))
    texts = spark.createDataFrame([("d1", "login and authentication"), ("d2", "weather report of today")], "object_id string, text string")
    return Tables(objects(spark, ["d1", "d2"]), a, e, texts)


@pytest.mark.parametrize(
    ("p", "want"),
    [
        (Eq("type", "pdf"), ["d1"]),
        (Contains("name", "report"), ["d1"]),
        (And((Eq("type", "pdf"), Contains("name", "report"))), ["d1"]),
        (And((Eq("type", "docx"), Contains("name", "report"))), []),
        (Or((Eq("type", "pdf"), Eq("type", "docx"))), ["d1", "d2"]),
        (And(), ["d1", "d2"]),
        (Or(), []),
        (Related("d1"), ["d2"]),
        (Related("d1") | Eq("type", "pdf"), ["d1", "d2"]),
        (Related("d1") & Eq("type", "pdf"), []),
        (Semantic("authentication", 1), ["d1"]),
        (SimilarTo("d1", 2), ["d2"]),
    ],
)
def test_predicates(spark, p, want):
    assert ids(compile(p, _store(spark))) == want


def test_wide_predicates(spark):
    rows = spark.createDataFrame([("a", "xyz"), ("b", None)], "k string, t string")
    assert compile_wide(Eq("t", None), rows).first().k == "b"
    assert compile_wide(And((Eq("k", "a"), Contains("t", "y"))), rows).count() == 1
    assert compile_wide(Or(), rows).count() == 0
    assert compile_wide(And(), rows).count() == 2


def test_checksums(spark):
    blocks = spark.createDataFrame([("123456789", 0xCBF43926), ("123456789", 1)], "payload string, checksum long")
    assert [r.checksum for r in integrity.checksum_mismatch(blocks).collect()] == [1]


def test_committed_entries(spark):
    """Begun and committed counts; aborted, begun anew, left open or never begun doesn't; sessions don't mix."""
    ops = ["add", "begin", "add", "add", "commit", "add", "begin", "add", "abort", "begin", "add", "begin", "add", "commit", "commit", "begin", "add"]
    rows = [(n, s, op, n) for n, op in enumerate(ops) for s in (1, 2)]
    got = versions.committed(spark.createDataFrame(rows, "seq long, session long, op string, payload long")).collect()
    assert sorted((r.session, r.seq) for r in got) == [(s, n) for s in (1, 2) for n in (2, 3, 12)]


def test_semantic_predicates(spark):
    """The nearest texts by brute force over their embeddings."""
    data = [(f"o{n}", f"{w} {v} text") for n, (w, v) in enumerate((w, v) for w in ("alpha", "beta", "gamma", "delta") for v in ("house", "garden", "horse", "window", "licence"))] + [("none", None)]
    texts = spark.createDataFrame(data, "object_id string, text string")
    from objectlake.schema import attribute

    attributes = attribute(texts.where("text is not null"), F.col("object_id"), "content", "string", F.col("text"))
    tables = Tables(texts.select("object_id"), attributes, texts=texts)
    vec = {i: np.array(codec.embed(t)) for i, t in data if t}

    def near(v, k):
        return sorted(vec, key=lambda i: (-float(vec[i] @ v), i))[:k]

    ids = lambda p: {r.object_id for r in compile(p, tables).collect()}
    query = np.array(codec.embed("gamma horse"))
    assert ids(Semantic("gamma horse", 4)) == set(near(query, 4))
    assert ids(SimilarTo("o3", 4)) == set(near(vec["o3"], 4)) - {"o3"}
    assert ids(And((Semantic("gamma horse", 6), Contains("content", "horse")))) == {i for i in near(query, 6) if "horse" in dict(data)[i]}
    assert ids(Or((SimilarTo("o3", 3), Contains("content", "beta")))) == (set(near(vec["o3"], 3)) - {"o3"}) | {i for i, t in data if t and "beta" in t}


def test_postings_for_a_query(spark):
    """The same hits as from the whole index; terms inside other words don't count."""
    texts = spark.createDataFrame([("a", "the License, the token"), ("b", "licensed tokens"), ("c", "License only"), ("d", None), ("e", "")], "object_id string, text string")
    whole = fulltext.postings(texts)
    for q in ("license token", "the", "", "absent", "license license"):
        scored = lambda df: sorted((r.object_id, r.score) for r in df.collect())
        assert scored(fulltext.search_any_term(fulltext.postings_for(texts, q), q)) == scored(fulltext.search_any_term(whole, q))
        assert scored(fulltext.search_all_terms(fulltext.postings_for(texts, q, True), q)) == scored(fulltext.search_all_terms(whole, q))
