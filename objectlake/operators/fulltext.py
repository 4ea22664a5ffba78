"""Postings, and searches for all or any of a query's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objectlake.functions.text import tokens


def postings(texts: DataFrame, dimension: str = "content") -> DataFrame:
    """(term, object_id, dimension, freq) of (object_id, text)."""
    each = texts.select("object_id", F.explode(tokens(F.col("text"))).alias("term"))
    return each.groupBy("term", "object_id").agg(F.count("*").alias("freq")).select("term", "object_id", F.lit(dimension).alias("dimension"), "freq")


def postings_for(texts: DataFrame, query: str, every: bool = False) -> DataFrame:
    """The postings that a query for any term, or for every one, can need: texts without them aren't cut into tokens at all."""
    low, found = F.lower("text"), None
    for t in _terms(query):
        has = F.contains(low, F.lit(t))
        found = has if found is None else (found & has if every else found | has)
    return postings(texts.where(F.lit(False) if found is None else found)).where(F.col("term").isin(_terms(query)))


def without(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("object_id"), "object_id", "left_anti").select(index.columns)


def _terms(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\s!-/:-@\[-`{-~]+", query.lower()) if t]


def search_all_terms(index: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """(object_id, score) of objects with every term: the sum of frequencies over the number of terms.

    Distinct terms have to be there; with `literal`, as many postings as the query has terms.
    """
    terms = _terms(query)
    found = index.where(F.col("term").isin(terms)).groupBy("object_id")
    weight = F.sum(F.col("freq") * _times(terms))
    if literal:
        found = found.agg(weight.alias("sum"), F.sum(_times(terms)).alias("n")).where(F.col("n") == len(terms))
    else:
        found = found.agg(weight.alias("sum"), F.count_distinct("term").alias("n")).where(F.col("n") == len(set(terms)))
    return found.select("object_id", (F.col("sum") / len(terms)).alias("score")) if terms else found.select("object_id", F.lit(0.0).alias("score")).limit(0)


def _times(terms: list[str]):
    """How often a query has the term of a row."""
    out = F.lit(0)
    for t in sorted(set(terms)):
        out = F.when(F.col("term") == t, terms.count(t)).otherwise(out)
    return out


def search_any_term(index: DataFrame, query: str) -> DataFrame:
    terms = _terms(query)
    return index.where(F.col("term").isin(terms)).groupBy("object_id").agg(F.sum(F.col("freq") * _times(terms)).cast("long").alias("score"))


def ranked(hits: DataFrame, n: int) -> DataFrame:
    """(object_id, score, rank) of the n best hits, of equally good ones by id."""
    best = hits.orderBy(F.desc("score"), "object_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "object_id")))  # n rows at most


def vocabulary_size(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("term").alias("n_terms"))
