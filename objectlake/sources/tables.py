"""Ordinary tables seen as objects, attributes, edges and an access log, lazily.

Each attribute is a branch of a union with a literal name, so that a filter on the name empties the other
branches while the plan is optimised, and only the columns of what is left are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.schema import attribute


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def object_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def document_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, oid = table(spark, sf_dir, "documents"), object_id("document", "doc_id")
    return union([attribute(docs, oid, n, t, F.col(c)) for n, t, c in (("content", "string", "text"), ("language", "string", "lang"), ("source", "string", "source"), ("n_chars", "int64", "n_chars"))])


def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, oid = table(spark, sf_dir, "pages"), object_id("page", "page_id")
    return union([attribute(pages, oid, "name", "string", F.col("url")), attribute(pages, oid, "content", "string", F.col("html"))])


def event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, oid = table(spark, sf_dir, "events"), object_id("event", "event_id")
    return union([attribute(events, oid, "intent", "string", F.col("event_type")), attribute(events, oid, "value", "float64", F.col("value")), attribute(events, oid, "content", "string", F.col("props"))])


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([f(spark, sf_dir) for f in (document_attributes, page_attributes, event_attributes)])


def tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, name) of regions, nations, customers and orders."""
    t = lambda n: table(spark, sf_dir, n)
    return union(
        [
            t("region").select(object_id("region", "r_regionkey").alias("object_id"), F.col("r_name").alias("name")),
            t("nation").select(object_id("nation", "n_nationkey").alias("object_id"), F.col("n_name").alias("name")),
            t("customer").select(object_id("customer", "c_custkey").alias("object_id"), F.col("c_name").alias("name")),
            t("orders").select(object_id("order", "o_orderkey").alias("object_id"), F.col("o_orderkey").cast("string").alias("name")),
        ]
    )


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, strength: Column | None = None, pos: Column | None = None) -> DataFrame:
    one, none = F.lit(1.0), F.lit(0)
    return df.select(src.alias("src"), (none if pos is None else pos).cast("int").alias("pos"), dst.alias("dst"), F.lit(kind).alias("kind"), (one if strength is None else strength).cast("double").alias("strength"), F.lit(None).cast("string").alias("label"))


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region contains nation contains customer contains order."""
    t = lambda n: table(spark, sf_dir, n)
    return union(
        [
            _edge(t("nation"), object_id("region", "n_regionkey"), object_id("nation", "n_nationkey"), "contains", pos=F.col("n_nationkey")),
            _edge(t("customer"), object_id("nation", "c_nationkey"), object_id("customer", "c_custkey"), "contains", pos=F.col("c_custkey")),
            _edge(t("orders"), object_id("customer", "o_custkey"), object_id("order", "o_orderkey"), "contains", pos=F.col("o_orderkey")),
        ]
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree, with orders that depend on parts (strength: a fiftieth of the quantity) and reference suppliers."""
    lines = table(spark, sf_dir, "lineitem")
    return union(
        [
            tree_edges(spark, sf_dir),
            _edge(lines, object_id("order", "l_orderkey"), object_id("part", "l_partkey"), "depends_on", F.col("l_quantity") / 50, F.col("l_linenumber")),
            _edge(lines, object_id("order", "l_orderkey"), object_id("supplier", "l_suppkey"), "references", pos=F.col("l_linenumber")),
        ]
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id) of all that edges can lead to."""
    keys = (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("orders", "order", "o_orderkey"), ("part", "part", "p_partkey"), ("supplier", "supplier", "s_suppkey"))
    return union([table(spark, sf_dir, t).select(object_id(k, c).alias("object_id")) for t, k, c in keys])


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, object_id, session, ts, access_type): users' events as accesses to the kind of event, written by purchases."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("object_id"), F.col("user_id").alias("session"), "ts", F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("access_type"))
