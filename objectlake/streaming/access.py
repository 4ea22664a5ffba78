"""Access logs as streams: counters, tiers, patterns and the prefetch queue kept up to date, and windows over time.

Each function takes a streaming DataFrame and returns one; settle() runs it over all that is there and gives the result as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from objectlake.session import shared_dir


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, source: str = "parquet") -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def counters(log: DataFrame) -> DataFrame:
    """(object_id, last_ts, total, reads, writes) of (seq, object_id, ts, access_type); the state is one row for each object."""
    return log.groupBy("object_id").agg(F.max_by("ts", "seq").alias("last_ts"), F.count("*").alias("total"), F.count_if(F.col("access_type") == "read").alias("reads"), F.count_if(F.col("access_type") == "write").alias("writes"))


def tiers(log: DataFrame) -> DataFrame:
    """(object_id, total, tier)."""
    total = F.col("total")
    return log.groupBy("object_id").agg(F.count("*").alias("total")).withColumn("tier", F.when(total <= 5, "hot").when(total <= 50, "warm").otherwise("cold"))


def windows(log: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, object_id, n) by tumbling or sliding windows of ts; what comes later than `late` is dropped."""
    times = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return times.groupBy(w.alias("w"), "object_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "object_id", "n")


def visits(log: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): accesses that follow each other within the gap."""
    times = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return times.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def patterns(log: DataFrame, key: str) -> DataFrame:
    """(key, a, b, next, freq): updates of how often `next` was confirmed after the pair (a, b) in each session.

    The state of a session: its last two accesses, and the successors of each pair. Within a batch the order is (ts, seq).
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending, freq = ([], {}, {}) if not state.exists else (list(state.get[0]), _unpack(state.get[1]), _unpack(state.get[2]))
        new = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        touched = set()
        for x in new.object_id:
            if len(last) == 2 and (pair := tuple(last)) is not None:
                pending.setdefault(pair, {})
                pending[pair][x] = pending[pair].get(x, 0) + 1
            last = [*last, x][-2:]
            if len(last) == 2:  # the pair that is complete now confirms all its successors so far
                for nxt, times in pending.get(tuple(last), {}).items():
                    freq.setdefault(tuple(last), {})
                    freq[tuple(last)][nxt] = freq[tuple(last)].get(nxt, 0) + times
                    touched.add((*last, nxt))
        state.update((last, _pack(pending), _pack(freq)))
        rows = sorted(touched)
        yield pd.DataFrame({key: [k[0]] * len(rows), "a": [r[0] for r in rows], "b": [r[1] for r in rows], "next": [r[2] for r in rows], "freq": [freq[r[0], r[1]][r[2]] for r in rows]})

    kind = log.schema[key].dataType.simpleString()
    out = f"{key} {kind}, a string, b string, next string, freq long"
    entry = "array<struct<a: string, b: string, next: string, n: long>>"
    return log.select(key, "object_id", "ts", "seq").groupBy(key).applyInPandasWithState(step, out, f"last array<string>, pending {entry}, freq {entry}", "update", GroupStateTimeout.NoTimeout)


def _pack(counts: dict) -> list[tuple]:
    return [(a, b, x, n) for (a, b), each in counts.items() for x, n in each.items()]


def _unpack(rows) -> dict:
    out: dict = {}
    for a, b, x, n in (tuple(r) for r in rows):
        out.setdefault((a, b), {})[x] = n
    return out


def prefetch(events: DataFrame) -> DataFrame:
    """(object_id, hits, misses): updates from (object_id, ts, seq, kind): "queue" puts an object into the queue, "access" is a hit if it is there, and takes it out.

    A batch is cut into ranges of (object_id, ts, seq), nulls last, and a range leaves one row for each of its objects: however many events
    an object has, its state gets no more rows than there are ranges.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each object in a range: the range's number, whether its first and last event put it into the queue, and the hits and misses after the first."""
        held, known = [], {}
        for batch in batches:
            ids = batch["object_id"].dictionary_encode("encode")
            codes = np.array([known.setdefault(x, len(known)) for x in ids.dictionary.to_pylist()], np.int32)
            held.append(pa.RecordBatch.from_arrays([pa.array(codes[ids.indices]), batch["ts"], batch["seq"], batch["queue"]], ["object", "ts", "seq", "queue"]))
        if not known:
            return
        rows = pa.Table.from_batches(held)
        order = pc.sort_indices(rows, [(c, "ascending") for c in ("object", "ts", "seq")])
        objects, queue = (rows[c].take(order).to_numpy() for c in ("object", "queue"))
        start = np.flatnonzero(np.r_[True, objects[1:] != objects[:-1]])
        before = np.r_[False, queue[:-1]]
        inner = ~queue
        inner[start] = False
        each = [np.add.reduceat(x, start, dtype=np.int64) for x in (inner & before, inner & ~before)]
        names = pa.array(list(known), pa.string()).take(pa.array(objects[start]))
        part = np.full(len(start), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([names, *map(pa.array, (part, queue[start], *each, queue[np.r_[start[1:], len(queue)] - 1]))], ["object_id", "part", "first", "hits", "misses", "last"])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queued, hits, misses = state.get if state.exists else (False, 0, 0)
        new = pd.concat(list(batches)).sort_values("part")
        for first, more_hits, more_misses, last in zip(*(new[c].tolist() for c in ("first", "hits", "misses", "last"))):
            hits += more_hits + (queued and not first)
            misses += more_misses + (not queued and not first)
            queued = last
        state.update((queued, hits, misses))
        yield pd.DataFrame({"object_id": [k[0]], "hits": [hits], "misses": [misses]})

    queue = F.coalesce(F.col("kind") == "queue", F.lit(False))
    own = events.select(F.col("object_id").cast("string").alias("object_id"), "ts", "seq", queue.alias("queue"))
    ranges = own.repartitionByRange(*map(F.asc_nulls_last, ("object_id", "ts", "seq"))).mapInArrow(runs, "object_id string, part int, first boolean, hits long, misses long, last boolean")
    return ranges.groupBy("object_id").applyInPandasWithState(step, "object_id string, hits long, misses long", "queued boolean, hits long, misses long", "update", GroupStateTimeout.NoTimeout)


def apply_changes(changes: DataFrame, dataset, name: str, checkpoint: str, key: str = "object_id"):
    """The writer of a stream of (seq, op, object_id, ...) that logs each batch and brings it into a table of a dataset; a batch that is repeated changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        dataset.log(rows)
        dataset.checkpoint(name, key)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def settle(stream: DataFrame, mode: str = "update", keys: tuple[str, ...] = ()) -> DataFrame:
    """All that a stream's source holds now, processed batch by batch; in update mode the last row of each key counts."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def batch(rows: DataFrame, n: int) -> None:
        rows.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/rows/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{at}/rows").drop("batch")
    if mode == "append":
        return found.drop("__batch")
    if mode == "complete":
        return found.join(found.agg(F.max("__batch").alias("__batch")), "__batch", "left_semi").drop("__batch")
    rest = [c for c in stream.columns if c not in keys]
    return found.groupBy(*keys).agg(*[F.max_by(c, "__batch").alias(c) for c in rest]).select(stream.columns)
