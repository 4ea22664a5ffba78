"""Tiers, retention and prediction from an access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objectlake.operators.stats import access_stats
from objectlake.session import cut


def tiers(objects: DataFrame, log: DataFrame) -> DataFrame:
    """(object_id, total, tier): hot up to 5 accesses, warm up to 50, cold beyond and where there are none."""
    stats = access_stats(log).select("object_id", "total")
    tier = F.when(F.col("total") <= 5, "hot").when(F.col("total") <= 50, "warm").otherwise("cold")
    return objects.select("object_id").join(stats, "object_id", "left").select("object_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"), tier.alias("tier"))


def retention(log: DataFrame, policies: DataFrame, now: str) -> DataFrame:
    """(object_id, age_s, action) where a policy applies: the first enabled one, by number, whose max_age_s the age exceeds.

    policies: policy_no, enabled, max_age_s, action. Ages are in whole seconds and never below 0.
    """
    seconds = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
    ages = access_stats(log).select("object_id", F.greatest(F.lit(0), seconds(F.lit(now)) - seconds(F.col("last_ts"))).cast("long").alias("age_s"))
    hit = ages.join(policies.where("enabled"), F.col("age_s") > F.col("max_age_s"))
    return hit.groupBy("object_id", "age_s").agg(F.min_by("action", "policy_no").alias("action"))


def sequenced(log: DataFrame, *order: str) -> DataFrame:
    """log with `nth`, its place from 1 in a total order, without gathering it in one task: sorted ranges, numbered within and offset by the counts of those before."""
    ranges = cut(log.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    counts = ranges.groupBy("__range").agg(F.count("*").alias("n"), F.min("__id").alias("first"))
    # one row for each range of the sort, so that the window over them is small
    offsets = counts.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n") - F.col("first")).alias("shift"))
    return ranges.join(F.broadcast(offsets), "__range").withColumn("nth", F.col("__id") + F.col("shift") + 1).drop("__range", "__id", "shift")


def flushes(log: DataFrame, size: int) -> DataFrame:
    """(batch, n, first_seq, last_seq, flushed): the log in the order of seq, cut at every `size` entries; a last batch that isn't full waits."""
    batch = F.floor((F.col("nth") - 1) / size).cast("long")
    return sequenced(log, "seq").groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), (F.count("*") >= size).alias("flushed"))


def patterns(log: DataFrame, session: str | None = None) -> DataFrame:
    """(a, b, next, freq, first_nth): how often `next` was confirmed after the pair (a, b), as the log was written.

    Each access confirms all earlier successors of the pair that it completes, so that a successor of the r-th of n occurrences
    counts n - r. The log is one sequence by (ts, seq), or one for each value of `session`.
    """
    if session:
        w = Window.partitionBy(session).orderBy("ts", "seq")
        rows = log.select(F.col(session).alias("s"), F.row_number().over(w).alias("nth"), F.col("object_id").alias("a"), F.lead("object_id", 1).over(w).alias("b"), F.lead("object_id", 2).over(w).alias("next")).where("b is not null")
        keys = ["s", "a", "b"]
    else:
        numbered = cut(sequenced(log.select("ts", "seq", "object_id"), "ts", "seq"))
        at = lambda k, name: numbered.select((F.col("nth") - k).alias("nth"), F.col("object_id").alias(name))
        rows = at(0, "a").join(at(1, "b"), "nth").join(at(2, "next"), "nth", "left")
        keys = ["a", "b"]
    pair = Window.partitionBy(*keys)
    counted = rows.withColumn("n", F.count("*").over(pair)).withColumn("r", F.row_number().over(pair.orderBy("nth")))
    found = counted.where("next is not null").groupBy(*keys, "next").agg(F.sum(F.col("n") - F.col("r")).cast("long").alias("freq"), F.min("nth").alias("first_nth"))
    return found.where("freq > 0").withColumnRenamed("s", session) if session else found.where("freq > 0")


def predict(log: DataFrame, above: int = 1) -> DataFrame:
    """(next, freq, rank) for the pair that the log ends with: successors confirmed more than once, in the order of their first occurrence."""
    last = log.orderBy(F.desc("ts"), F.desc("seq")).limit(2).agg(F.min_by("object_id", F.struct("ts", "seq")).alias("a"), F.max_by("object_id", F.struct("ts", "seq")).alias("b"))
    found = patterns(log).join(F.broadcast(last), ["a", "b"]).where(F.col("freq") > above)
    return found.select("next", "freq", F.row_number().over(Window.orderBy("first_nth")).alias("rank"))


def log_tail(log: DataFrame, session: str, keep: int) -> DataFrame:
    """The last `keep` accesses of each session."""
    w = Window.partitionBy(session).orderBy(F.desc("ts"), F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def prefetch_hits(log: DataFrame, queue: DataFrame) -> DataFrame:
    """One row (hits, misses, hit_rate) of accesses against a queue (object_id, queued_ts): an entry is hit by the first access after it, and then gone."""
    entries = queue.groupBy("object_id").agg(F.min("queued_ts").alias("queued_ts"))
    after = log.join(entries, "object_id").where(F.col("ts") >= F.col("queued_ts")).select("object_id").distinct()
    total, hits = log.agg(F.count("*").alias("total")), after.agg(F.count("*").alias("hits"))
    both = hits.crossJoin(total)
    return both.select("hits", (F.col("total") - F.col("hits")).alias("misses"), F.round(F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)), 6).alias("hit_rate"))
