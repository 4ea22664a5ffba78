"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from objectlake.llm import bpe, decontaminate, knn, language, licenses, near_dedup, pii, quality, reputation, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        decontaminate.op1_decontamination,
        language.op2_language_id,
        token_store.op3_token_store,
        bpe.op4_byte_level_bpe,
        knn.op5_exact_top_k,
        quality.op6_quality_classifier,
        reputation.op7_url_reputation,
        pii.op8_pii,
        near_dedup.op9_simhash_near_dedup,
        licenses.op10_license_scan,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": knn.SQL, "op7_url_reputation": reputation.SQL}
