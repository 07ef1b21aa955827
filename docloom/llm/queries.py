"""The training-data queries, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, language_id, lm_scoring, near_dedup, packing, spotsigs, substring_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_chat_format": chat.query,
    "op3_language_id": language_id.query,
    "op4_spotsigs": spotsigs.query,
    "op5_url_filter": url_filter.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_byte_bpe": bpe.query,
    "op8_near_dedup": near_dedup.query,
    "op9_ann": ann.query,
    "op10_lm_scoring": lm_scoring.query,
}

ORACLES: dict[str, str] = {
    "op1_packing": packing.SQL,
    "op4_spotsigs": spotsigs.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op10_lm_scoring": lm_scoring.SQL,
}
