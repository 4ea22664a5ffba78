"""A corpus pipeline: quality, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result as
Parquet into the shared folder and reads it again. All stages but the last return the columns that they are given; the
last returns doc_id, n_tokens, tokens and the text that the tokens decode to. What a stage was given is
removed once the next one's result is written whole.

Defined cases: documents with a null, empty or blank text are rejected by the quality classifier where there are labels of both kinds, and
go through all stages where there aren't, with null tokens for a null text. Ids may be null or repeated: rows are
told apart by all their columns, and of equal rows one stays, as of near copies the one with the least
id. Very long texts are read whole by each stage. Ties are decided as each operator says. Empty tables give an empty result; without
labels all documents are kept, without a benchmark none is contaminated. Further columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from objectlake.llm import bpe, decontaminate, near_dedup, pii, quality
from objectlake.llm.common import remove, shared_dir, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all that are in none."""
    return near_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in text, and n_chars after that."""
    return pii.redact_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and the text that they decode to."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("near duplicates", distinct),
    ("benchmark decontamination", clean),
    ("personal data", private),
    ("byte-level BPE", tokens),
]

#: No stage but the removal of equal rows has a form in SQL; tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return docs
