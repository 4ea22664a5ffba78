"""Versions of objects, and replay of change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_newest(versions: DataFrame, n: int) -> DataFrame:
    """The newest n versions of each object; all of them for 0."""
    if not n:
        return versions
    w = Window.partitionBy("object_id").orderBy(F.desc("version"))
    return versions.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c not in ("object_id", "version")]
    return versions.groupBy("object_id").agg(F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in rest])


def pruned(versions: DataFrame, before: int) -> DataFrame:
    return versions.where(F.col("version") >= before)


def as_of(versions: DataFrame, version: int) -> DataFrame:
    return latest(versions.where(F.col("version") <= version))


def diff(versions: DataFrame, a: int, b: int) -> DataFrame:
    """(object_id, changed) of objects that have both versions."""
    side = lambda v, name: versions.where(F.col("version") == v).select("object_id", F.sha2("content", 256).alias(name))
    return side(a, "ha").join(side(b, "hb"), "object_id").select("object_id", (F.col("ha") != F.col("hb")).alias("changed"))


def replay(log: DataFrame, checkpoint: int = 0) -> DataFrame:
    """The last operation of each object after a checkpoint; deleted objects are gone. log: seq, op (write or delete), object_id, and the rest."""
    rest = [c for c in log.columns if c not in ("object_id", "seq", "op")]
    last = log.where(F.col("seq") > checkpoint).groupBy("object_id").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in rest])
    return last.where("op = 'write'").drop("op")


def committed(journal: DataFrame) -> DataFrame:
    """(seq, session, payload) of the entries of transactions that were begun and committed. journal: seq, session, op (begin, add, commit or abort), payload.

    A transaction of a session goes from its begin to the next begin, commit or abort; only the last but one counts.
    """
    marks = F.col("op").isin("begin", "commit", "abort")
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spans = journal.withColumn("span", F.coalesce(F.sum(F.when(marks, 1).otherwise(0)).over(before), F.lit(0)))
    ends = spans.groupBy("session", "span").agg(F.max(F.when(marks, F.col("op"))).alias("ending")).where("ending = 'commit'")
    opened = spans.where("op = 'begin'").select("session", (F.col("span") + 1).alias("span"))
    return spans.where("op = 'add'").join(ends, ["session", "span"]).join(opened, ["session", "span"]).select("seq", "session", "payload")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of `changes` in place of the ones with the same keys."""
    return rows.join(changes.select(keys).distinct(), keys, "left_anti").select(rows.columns).unionByName(changes.select(rows.columns))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(keys), keys, "left_anti").select(rows.columns)
