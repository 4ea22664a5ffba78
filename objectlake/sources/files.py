"""Files as objects, and tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.schema import attribute, meta
from objectlake.sources.tables import union


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Attributes name, content and size of each file; the id is the hash of its path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    oid, when = F.sha2(F.concat(F.lit("file:"), F.col("path")), 256), meta(F.unix_micros("modificationTime") * 1000)
    return union([attribute(files, oid, "name", "string", F.element_at(F.split("path", "/"), -1), when), attribute(files, oid, "content", "binary", F.col("content"), when), attribute(files, oid, "size", "int64", F.col("length"), when)])


def read_any(spark: SparkSession, path: str, source: str, schema: str | None = None, **options: str) -> DataFrame:
    """Any of Spark's formats: parquet, orc, csv, json, text, jdbc."""
    reader = spark.read.format(source).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_attributes(attributes: DataFrame, path: str, names: tuple[str, ...] = ("name", "content", "language", "quality", "role")) -> None:
    """Parquet, partitioned by the name where it is a well-known one, so that reading one attribute leaves the other files alone."""
    bounded = F.when(F.col("name").isin(*names), F.col("name")).otherwise("other")
    attributes.withColumn("name_class", bounded).write.mode("overwrite").partitionBy("name_class").parquet(path)


def read_attribute(spark: SparkSession, path: str, name: str, names: tuple[str, ...] = ("name", "content", "language", "quality", "role")) -> DataFrame:
    return spark.read.parquet(path).where((F.col("name_class") == (name if name in names else "other")) & (F.col("name") == name)).drop("name_class")
