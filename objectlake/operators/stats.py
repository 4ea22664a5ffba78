"""Counts and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(top) if top else counted


def dedup_stats(values: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, references, hits (references beyond the first), their ratio, bytes saved, stored and referenced."""
    each = values.groupBy(F.sha2(F.col(column).cast("binary"), 256).alias("hash")).agg(F.count("*").alias("refs"), F.max(F.octet_length(column)).alias("size"))
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    refs, size = F.col("refs"), F.col("size")
    out = each.agg(F.count("*").alias("unique_values"), n(refs, "refs"), n(refs - 1, "hits"), n(size * (refs - 1), "bytes_saved"), n(size, "bytes_stored"), n(size * refs, "bytes_referenced"))
    return out.withColumn("ratio", F.round(F.coalesce(F.try_divide("hits", "refs"), F.lit(0.0)), 6))


def live_references(changes: DataFrame) -> DataFrame:
    """(hash, refs) of what is still referred to, from signed changes (hash, delta)."""
    return changes.groupBy("hash").agg(F.sum("delta").cast("long").alias("refs")).where("refs > 0")


def canonical_hash(attributes: DataFrame) -> DataFrame:
    """(object_id, hash) over names and payloads in the order of names, without separators, tags or provenance."""
    payload = F.coalesce("v_string", F.col("v_long").cast("string"), F.col("v_double").cast("string"), F.col("v_bool").cast("string"), "v_ref", F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct("name", payload.alias("p"))))
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["name"], x["p"])), "")
    return attributes.groupBy("object_id").agg(F.sha2(joined, 256).alias("hash"))


def access_stats(log: DataFrame) -> DataFrame:
    """(object_id, last_ts, total, reads, writes); last_ts is that of the last access recorded."""
    return log.groupBy("object_id").agg(F.max_by("ts", "seq").alias("last_ts"), F.count("*").alias("total"), F.count_if(F.col("access_type") == "read").alias("reads"), F.count_if(F.col("access_type") == "write").alias("writes"))


def blocks(name: Column, payload_bytes: Column) -> Column:
    """Blocks that a value takes: one if it fits beside its name, else one and chained ones."""
    encoded = payload_bytes + 9 + 46
    return F.when(encoded + 18 + F.octet_length(name) <= 4096, 1).otherwise(1 + F.ceil((encoded - (4096 - 18 - F.octet_length(name))) / 4080)).cast("long")
