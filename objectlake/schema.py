"""The tables of the model, and how typed attribute values are built and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECTS = "object_id string, created_at_ns long, modified_at_ns long"
META = "struct<ts_ns: long, origin: string, confidence: float, enc_ver: int>"
ATTRIBUTES = f"object_id string, name string, tag string, v_bool boolean, v_long long, v_double double, v_string string, v_binary binary, v_vector array<float>, v_ref string, meta {META}"
EDGES = "src string, pos int, dst string, kind string, strength double, label string"
ACCESS_LOG = "seq long, object_id string, ts timestamp_ntz, access_type string"

#: tag -> (column, Spark type); "null" has no column: such an attribute is present without a value.
TAGS = {"null": None, "bool": ("v_bool", "boolean"), "int64": ("v_long", "bigint"), "float64": ("v_double", "double"), "string": ("v_string", "string"), "binary": ("v_binary", "binary"), "vector": ("v_vector", "array<float>"), "ref": ("v_ref", "string")}
KINDS = ("contains", "depends_on", "related_to", "version_of", "references", "composed_of", "derived_from", "computed_by", "custom")
ROLES = ("asset", "cache", "config", "data", "documentation", "model", "source", "test", "unknown")


def meta(ts_ns: int | Column = 0, origin: str | None = None, confidence: float | Column = 1.0, version: int = 1) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(ts_ns).cast("long").alias("ts_ns"), F.lit(origin).cast("string").alias("origin"), as_column(confidence).cast("float").alias("confidence"), F.lit(version).cast("int").alias("enc_ver"))


def value_columns(tag: str, value: Column | None) -> list[Column]:
    """The v_ columns of an attribute, all but one null."""
    own = TAGS[tag]
    return [(value if own and own[0] == c else F.lit(None)).cast(t).alias(c) for c, t in (x for x in TAGS.values() if x)]


def attribute(objects: DataFrame, object_id: Column, name: str, tag: str, value: Column | None, about: Column | None = None) -> DataFrame:
    """Attribute rows with one name, for each row of `objects`."""
    return objects.select(object_id.alias("object_id"), F.lit(name).alias("name"), F.lit(tag).alias("tag"), *value_columns(tag, value), (meta() if about is None else about).alias("meta"))


def attributes_of(objects: DataFrame, object_id: Column, values: list[tuple[str, str, Column]]) -> DataFrame:
    """Attribute rows of several (name, tag, value) of each row, in one pass; null values give none."""
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(tag).alias("tag"), *value_columns(tag, value)) for name, tag, value in values])
    there = [c for c, _ in (x for x in TAGS.values() if x)]
    rows = objects.select(object_id.alias("object_id"), F.inline(F.filter(each, lambda x: F.greatest(*[x[c].isNotNull() for c in there]))))
    return rows.withColumn("meta", meta())


def read_as(tag: str) -> Column:
    """The value of an attribute row if it carries the tag, else null."""
    column, kind = TAGS[tag]
    return F.when(F.col("tag") == tag, F.col(column)).otherwise(F.lit(None).cast(kind))


def kind_of(code: Column) -> Column:
    """The kind with a numeric code; codes past the last one are custom."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in KINDS]), (code + 1).cast("int")), F.lit("custom"))


def wide(attributes: DataFrame, names: dict[str, str]) -> DataFrame:
    """A row for each object with a column for each name, of the tag given; the latest row counts where a name repeats."""
    picked = attributes.where(F.col("name").isin(list(names)))
    return picked.groupBy("object_id").agg(*[F.max_by(F.when(F.col("name") == n, read_as(t)), F.when(F.col("name") == n, F.col("meta.ts_ns"))).alias(n) for n, t in names.items()])
