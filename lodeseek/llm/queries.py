"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, bpe_sql, chat_format, decontam, html_extract, lm_scoring, mixing, near_dedup, period_runs, substring_dedup, token_rollup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_token_counts": token_rollup.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_chat_format": chat_format.query,
        "op5_lm_scoring": lm_scoring.query,
        "op6_ann_search": ann.query,
        "op7_decontaminate": decontam.query,
        "op8_mix_sources": mixing.query,
        "op9_near_dedup": near_dedup.query,
        "op10_html_extract": html_extract.query,
        "op11_token_alignment": alignment.query,
        "op12_period_runs": period_runs.query,
        "op13_bpe_duckdb": bpe_sql.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substring_dedup.SQL, "op4_chat_format": chat_format.SQL}
