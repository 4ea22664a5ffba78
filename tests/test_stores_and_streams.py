"""Datasets with snapshots and change logs, files as objects, and streams against the same thing in one batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from objectlake.operators import lifecycle, stats
from objectlake.sources import files
from objectlake.sources.dataset import Conflict, Dataset
from objectlake.sources.tables import access_log
from objectlake.streaming import access
from tests.conftest import SF_DIR


def frame(spark, *rows):
    return spark.createDataFrame(rows, "object_id string, content string")


def content(df):
    return {r.object_id: r.content for r in df.collect()}


@pytest.fixture
def dataset(spark, tmp_path):
    return Dataset(spark, f"file://{tmp_path}/set")


def test_snapshot_and_restore(spark, dataset):
    dataset.commit(objects=frame(spark, ("a", "v1")))
    assert dataset.snapshot("first") == 1
    dataset.commit(objects=frame(spark, ("a", "v2")))
    assert dataset.snapshot("second") == 2
    assert content(dataset.read("objects")) == {"a": "v2"}
    dataset.restore(1)
    assert content(dataset.read("objects")) == {"a": "v1"}
    assert [(r.snapshot_id, r.label) for r in dataset.snapshots().orderBy("snapshot_id").collect()] == [(1, "first"), (2, "second")]
    assert content(dataset.read("objects", 2)) == {"a": "v2"}


def test_unknown(spark, dataset):
    with pytest.raises(KeyError):
        dataset.restore(7)
    with pytest.raises(KeyError):
        dataset.read("nothing")
    with pytest.raises(KeyError):
        dataset.manifest(3)
    assert dataset.snapshots().count() == 0
    assert dataset.problems() == []


def test_compaction_keeps_snapshots(spark, dataset):
    dataset.commit(objects=frame(spark, ("a", "v1")))
    dataset.snapshot()
    for n in range(2, 5):
        dataset.commit(objects=frame(spark, ("a", f"v{n}")))
    assert len(dataset.unreferenced()) == 2
    kept, freed = dataset.compact()
    assert kept == 2
    assert freed > 0
    assert dataset.unreferenced() == []
    assert dataset.problems() == []
    assert content(dataset.read("objects")) == {"a": "v4"}
    dataset.restore(1)
    assert content(dataset.read("objects")) == {"a": "v1"}


def test_table_from_itself(spark, dataset):
    dataset.commit(objects=frame(spark, ("a", "x")))
    dataset.commit(objects=dataset.read("objects").withColumn("content", F.upper("content")))
    assert content(dataset.read("objects")) == {"a": "X"}


def test_second_writer_is_refused(spark, dataset):
    base = dataset.manifest()
    dataset.commit(objects=frame(spark, ("a", "x")))
    with pytest.raises(Conflict):
        dataset._advance(base)


def test_change_log(spark, dataset):
    schema = "seq long, op string, object_id string, content string"
    dataset.log(spark.createDataFrame([(1, "write", "a", "1"), (2, "write", "b", "2"), (3, "write", "a", "3")], schema))
    dataset.checkpoint("objects")
    assert content(dataset.read("objects")) == {"a": "3", "b": "2"}
    dataset.log(spark.createDataFrame([(4, "delete", "b", None), (5, "write", "c", "5")], schema))
    assert sorted(r.seq for r in dataset.pending().collect()) == [4, 5]
    dataset.checkpoint("objects")
    assert content(dataset.read("objects")) == {"a": "3", "c": "5"}
    version = dataset.manifest()["version"]
    assert dataset.checkpoint("objects") == version


def test_change_stream_that_repeats(spark, dataset, tmp_path):
    schema = "seq long, op string, object_id string, content string"
    changes = spark.createDataFrame([(1, "write", "a", "1"), (2, "write", "b", "2")], schema)
    changes.write.parquet(f"{tmp_path}/in")
    stream = access.read_log(spark, f"{tmp_path}/in", schema)
    for n in (1, 2):  # the second time as after the loss of the stream's own checkpoint
        access.apply_changes(stream, dataset, "objects", f"{tmp_path}/state{n}").trigger(availableNow=True).start().awaitTermination()
        assert content(dataset.read("objects")) == {"a": "1", "b": "2"}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.txt").write_text("hello")
    (tmp_path / "y.bin").write_bytes(b"\0\1")
    found = files.read_files(spark, str(tmp_path))
    assert {r.v_string for r in found.where("name = 'name'").collect()} == {"x.txt", "y.bin"}
    assert {r.v_long for r in found.where("name = 'size'").collect()} == {5, 2}
    assert files.read_files(spark, str(tmp_path), "*.txt").count() == 3


def test_partitioned_attributes(spark, tmp_path):
    found = spark.createDataFrame([("a", "name", "n"), ("a", "rare", "r")], "object_id string, name string, v_string string")
    files.write_attributes(found, f"{tmp_path}/attributes")
    assert files.read_attribute(spark, f"{tmp_path}/attributes", "rare").first().v_string == "r"
    assert files.read_attribute(spark, f"{tmp_path}/attributes", "name").first().v_string == "n"


@pytest.mark.parametrize("source", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, source):
    frame(spark, ("a", "x"), ("b", "y")).write.format(source).save(f"{tmp_path}/t")
    assert content(files.read_any(spark, f"{tmp_path}/t", source, "object_id string, content string")) == {"a": "x", "b": "y"}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The access log in several files, in order."""
    folder = tmp_path_factory.mktemp("log")
    log = access_log(spark, SF_DIR)
    for n, (low, high) in enumerate(((0, 300), (300, 301), (301, 700), (700, 10**9))):
        log.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(str(folder))
    return access.read_log(spark, str(folder), log.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), 1)


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(tuple, a.select(columns).collect()), key=repr) == sorted(map(tuple, b.select(columns).collect()), key=repr)


def test_counters_in_batches(spark, parts):
    same(access.settle(access.counters(parts), keys=("object_id",)), stats.access_stats(access_log(spark, SF_DIR)))


def test_patterns_in_batches(spark):
    """Sessions in several batches, cut anywhere, give what one batch gives."""
    rows = [(n, "abc"[n * n % 3] if n % 7 else "d", n % 3, n) for n in range(120)]
    log = spark.createDataFrame(rows, "seq long, object_id string, session long, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        for a, b in ((0, 50), (50, 51), (51, 120)):
            log.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(folder)
        stream = access.read_log(spark, folder, "seq long, object_id string, session long, ts timestamp_ntz", 1)
        same(access.settle(access.patterns(stream, "session"), keys=("session", "a", "b", "next")), lifecycle.patterns(log, "session").drop("first_nth"))


def test_prefetch_queue(spark, tmp_path):
    rows = [("a", 1, "queue"), ("a", 2, "access"), ("a", 3, "access"), ("b", 4, "access"), ("b", 5, "queue"), ("b", 6, "queue"), ("b", 7, "access")]
    spark.createDataFrame(rows, "object_id string, seq long, kind string").withColumn("ts", F.timestamp_seconds("seq")).write.parquet(f"{tmp_path}/q")
    stream = access.read_log(spark, f"{tmp_path}/q", "object_id string, seq long, kind string, ts timestamp")
    assert {tuple(r) for r in access.settle(access.prefetch(stream), keys=("object_id",)).collect()} == {("a", 1, 1), ("b", 1, 1)}


def test_late_data_is_dropped(spark, tmp_path):
    base = 1_700_000_000 - 1_700_000_000 % 86400
    for n, seconds in enumerate(([0, 10], [5 * 86400], [5 * 86400 + 1], [20])):  # a batch's own times count from the batch after the next
        spark.createDataFrame([(n, "a", base + s) for s in seconds], "seq long, object_id string, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/l")
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    stream = access.read_log(spark, f"{tmp_path}/l", "seq long, object_id string, ts timestamp_ntz", 1)
    found = access.settle(access.windows(stream), "append").orderBy("start").collect()
    assert [r.n for r in found] == [2]  # the last file came too late, and the other window is still open
    sliding = access.settle(access.windows(stream, "2 days", "1 day"), "update", ("start", "end", "object_id"))
    assert sliding.count() >= 4


def test_late_changes_count(dataset, spark):
    """A batch that comes late with smaller numbers is taken in, but doesn't undo a later change of the same object."""
    log = lambda *rows: dataset.log(spark.createDataFrame(list(rows), "seq long, op string, object_id string, v long"))
    log((10, "write", "a", 1), (11, "write", "c", 1), (12, "delete", "c", None))
    dataset.checkpoint("t")
    log((5, "write", "b", 2), (4, "write", "a", 9), (6, "write", "c", 9))
    assert dataset.pending().count() == 3
    dataset.checkpoint("t")
    assert dataset.pending().count() == 0
    assert {r.object_id: r.v for r in dataset.read("t").collect()} == {"a": 1, "b": 2}
    log((13, "write", "c", 3), (14, "delete", "a", None))
    dataset.checkpoint("t")
    assert {r.object_id: r.v for r in dataset.read("t").collect()} == {"b": 2, "c": 3}


def test_a_file_is_put_once(dataset):
    dataset._put("manifests/x.json", {"a": 1})
    with pytest.raises(Conflict):
        dataset._put("manifests/x.json", {"a": 2})
    assert dataset._get("manifests/x.json") == {"a": 1}


def test_prefetch_sends_a_row_for_each_range(spark, tmp_path, monkeypatch):
    """Against a plain loop, in two batches with null times, ties and objects: what reaches the state is a few rows, not the events."""
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), n, rng.choice(["queue", "access", None]), rng.choice([None, *range(200)])) for n in range(20_000)]
    want: dict = {}
    for part in (rows[:12_000], rows[12_000:]):
        for oid, _, kind, _ in sorted(part, key=lambda r: (r[3] is None, r[3] or 0, r[1])):
            queued, hits, misses = want.get(oid, (False, 0, 0))
            want[oid] = (True, hits, misses) if kind == "queue" else (False, hits + queued, misses + (not queued))
        log = spark.createDataFrame(part, "object_id string, seq long, kind string, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
        log.coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    stream = access.read_log(spark, f"{tmp_path}/q", "object_id string, seq long, kind string, ts timestamp_ntz", 1)
    seen = spark.sparkContext.accumulator(0)
    grouped = type(stream.groupBy("object_id")).applyInPandasWithState

    def counted(self, step, *more):
        def counting(k, batches, state):
            own = list(batches)
            seen.add(sum(map(len, own)))
            return step(k, iter(own), state)

        return grouped(self, counting, *more)

    monkeypatch.setattr(type(stream.groupBy("object_id")), "applyInPandasWithState", counted)
    got = {r.object_id: (r.hits, r.misses) for r in access.settle(access.prefetch(stream), keys=("object_id",)).collect()}
    assert got == {k: v[1:] for k, v in want.items()}
    assert 0 < seen.value <= 2 * (4 + 2)  # in each batch, a row for each of four ranges, and one more where an object ends within a range
