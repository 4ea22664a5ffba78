"""Checks of whole datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.operators import graph


def duplicate_ids(objects: DataFrame) -> DataFrame:
    return objects.groupBy("object_id").agg(F.count("*").alias("n")).where("n > 1")


def reference_mismatch(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(hash, expected, refs) where the recorded count isn't the actual one, also of hashes that only one side has."""
    both = recorded.select("hash", F.col("refs").alias("expected")).join(actual.select("hash", "refs"), "hash", "full_outer")
    return both.select("hash", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("refs", F.lit(0)).cast("long").alias("refs")).where("expected <> refs")


def checksum_mismatch(blocks: DataFrame) -> DataFrame:
    """Blocks whose stored checksum isn't that of their payload."""
    return blocks.where(F.crc32(F.col("payload").cast("binary")) != F.col("checksum"))


def readable(blocks: DataFrame) -> DataFrame:
    """Blocks whose stored checksum is that of their payload; the others are skipped."""
    return blocks.where(F.crc32(F.col("payload").cast("binary")) == F.col("checksum"))


def _count(df: DataFrame, name: str, test: Column | None = None) -> DataFrame:
    return (df if test is None else df.where(test)).agg(F.count("*").alias(name))


def report(objects: DataFrame, edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row of counts, and whether those that are errors are all 0."""
    parts = [
        _count(objects, "n_objects"),
        _count(edges, "n_edges"),
        _count(attributes, "n_attributes"),
        _count(duplicate_ids(objects), "duplicate_ids"),
        _count(graph.dangling(edges, objects), "dangling_edges"),
        _count(graph.orphans(objects, edges), "orphans"),
        _count(edges, "bad_strength", (F.col("strength") < 0) | (F.col("strength") > 1)),
        _count(attributes.join(objects, "object_id", "left_anti"), "stray_attributes"),
    ]
    errors = ("duplicate_ids", "dangling_edges", "bad_strength", "stray_attributes")
    # single rows only
    return reduce(DataFrame.crossJoin, parts).withColumn("clean", reduce(Column.__and__, [F.col(e) == 0 for e in errors]))
