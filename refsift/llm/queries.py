"""The queries of this package and, where SQL can express them, their SQL for an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refsift.llm import ann, chat_format, decontaminate, hard_negatives, lm_score, merkle, near_dedup, packing, pii, quality, secret_scan, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_packing": packing.op2_packing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_ann": ann.op4_ann,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_pii": pii.op8_pii,
    "op9_quality": quality.op9_quality,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op8_pii": pii.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
