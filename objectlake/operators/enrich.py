"""Enrichment of objects with a name, content and a given type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.functions import text as T
from objectlake.schema import attributes_of


def analyze(rows: DataFrame) -> DataFrame:
    """(object_id, detected_type, extracted_text, tags, language, quality, summary) of (object_id, name, content, content_type, n_edges), null where unknown."""
    typed = rows.withColumn("detected_type", F.coalesce("content_type", T.content_type(F.col("content")), F.lit("application/octet-stream")))
    read = typed.withColumn("extracted_text", T.extract_text(F.col("content"), F.col("detected_type")))
    text = F.coalesce("extracted_text", F.lit(""))
    tagged = read.withColumn("tags", F.when(F.col("extracted_text").isNotNull(), F.array_sort(F.array_distinct(F.concat(T.rule_tags(text, F.col("detected_type")), T.frequent_words(text))))).otherwise(F.array().cast("array<string>")))
    score = T.quality(F.col("name").isNotNull(), F.col("content").isNotNull(), F.col("extracted_text").isNotNull(), F.size("tags"), F.col("n_edges") > 0)
    return tagged.select("object_id", "detected_type", "extracted_text", "tags", T.language(F.col("extracted_text")).alias("language"), score.alias("quality"), F.when(F.col("extracted_text").isNotNull(), T.summary(F.col("extracted_text"))).alias("summary"))


def enrich(rows: DataFrame) -> DataFrame:
    """Attribute rows of what analyze() finds; nothing for what it doesn't."""
    a = analyze(rows)
    oid = F.col("object_id")
    parts = [("_detected_type", "string", F.col("detected_type")), ("_extracted_text", "string", F.col("extracted_text")), ("_auto_tags", "string", F.when(F.size("tags") > 0, F.array_join("tags", ", "))), ("_language", "string", F.col("language")), ("_quality", "float64", F.col("quality")), ("_summary", "string", F.col("summary"))]
    return attributes_of(a, oid, parts)


def profile(rows: DataFrame) -> DataFrame:
    """Attribute rows content_type, encoding, role, language and quality of rows with these columns; language only where it is known, tags never."""
    oid = F.col("object_id")
    parts = [("content_type", "string", F.col("content_type")), ("encoding", "string", F.coalesce("encoding", F.lit("utf8"))), ("role", "string", F.coalesce("role", F.lit("unknown"))), ("quality", "float64", F.coalesce("quality", F.lit(0.0)))]
    return attributes_of(rows, oid, [*parts, ("language", "string", F.col("language"))])
