"""Models stored in layers, with those of a base model under a fine-tuned one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_fallback(layers: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, layer, data, own): each model's layers, and those of its base that it lacks; one level. layers: model_id, layer, data; models: model_id, base_id."""
    own = layers.select("model_id", "layer", "data", F.lit(True).alias("own"))
    base = models.where("base_id is not null").join(layers.withColumnRenamed("model_id", "base_id"), "base_id").select("model_id", "layer", "data", F.lit(False).alias("own"))
    return own.unionByName(base.join(own.select("model_id", "layer"), ["model_id", "layer"], "left_anti"))


def savings(layers: DataFrame, models: DataFrame) -> DataFrame:
    """One row (full, stored) in bytes. Stored: all layers. Full: the same, but a fine-tuned model counts as its base's layers, or as 0 if the base is unknown.

    Layers named kv:* are caches: stored with their model, and not part of what a base lends.
    """
    size = F.octet_length("data")
    per = layers.groupBy("model_id").agg(F.sum(size).alias("stored"), F.sum(F.when(~F.startswith("layer", F.lit("kv:")), size).otherwise(0)).alias("weights"))
    base = models.join(models.select(F.col("model_id").alias("base_id"), F.lit(1).alias("known")), "base_id", "left").join(per.select(F.col("model_id").alias("base_id"), F.col("weights").alias("lent")), "base_id", "left")
    each = base.join(per, "model_id", "left").select(F.coalesce("stored", F.lit(0)).alias("stored"), F.when(F.col("base_id").isNull(), F.coalesce("stored", F.lit(0))).when(F.col("known") == 1, F.coalesce("lent", F.lit(0))).otherwise(0).alias("full"))
    return each.agg(F.coalesce(F.sum("full"), F.lit(0)).cast("long").alias("full_bytes"), F.coalesce(F.sum("stored"), F.lit(0)).cast("long").alias("stored_bytes"))


def sessions(cache: DataFrame) -> DataFrame:
    """(model_id, session_id, layer, data, nth): the newest data of each key, layers numbered in the order of their names. cache: with seq."""
    from pyspark.sql import Window

    newest = cache.groupBy("model_id", "session_id", "layer").agg(F.max_by("data", "seq").alias("data"))
    return newest.withColumn("nth", F.row_number().over(Window.partitionBy("model_id", "session_id").orderBy("layer")))
