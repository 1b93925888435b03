"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerlake.llm import (
    op1_html,
    op2_simhash,
    op3_chat,
    op4_packing,
    op5_toxicity,
    op6_decontaminate,
    op7_pii,
    op8_embeddings,
    op9_language,
    op10_substrings,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = [
        op1_html.op1_html_extraction,
        op2_simhash.op2_simhash_near_dedup,
        op3_chat.op3_chat_format,
        op4_packing.op4_best_fit_packing,
        op5_toxicity.op5_toxicity,
        op6_decontaminate.op6_decontamination,
        op7_pii.op7_pii,
        op8_embeddings.op8_embedding_near_dedup,
        op9_language.op9_language_id,
        op10_substrings.op10_substring_dedup,
    ]
    return {f.__name__: f for f in functions} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force or on held-out rows."""
    found = {"op3_chat_format": op3_chat.ORACLE_SQL, "op8_embedding_near_dedup": op8_embeddings.ORACLE_SQL, "op10_substring_dedup": op10_substrings.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql is not None}
