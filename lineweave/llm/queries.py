"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, html, jaccard, lm, mixing, quality, secrets, substrings, topk
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": lambda spark, d: bpe.digest(table(spark, d, "documents")),
    "op10_main_text": lambda spark, d: html.main_text(table(spark, d, "pages")),
    "op2_substring_dedup": lambda spark, d: substrings.repeats(table(spark, d, "documents")),
    "op3_secret_scan": lambda spark, d: secrets.digest(table(spark, d, "documents")),
    "op4_chat_format": lambda spark, d: chat.digest(table(spark, d, "conversations")),
    "op5_exact_topk": lambda spark, d: topk.digest(table(spark, d, "embeddings")),
    "op6_source_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
    "op7_ngram_jaccard": lambda spark, d: jaccard.digest(table(spark, d, "documents")),
    "op8_lm_scores": lambda spark, d: lm.digest(table(spark, d, "documents")),
    "op9_quality_rules": lambda spark, d: quality.digest(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op4_chat_format": chat.SQL,
    "op5_exact_topk": topk.SQL,
    "op7_ngram_jaccard": jaccard.SQL,
    "op8_lm_scores": lm.SQL,
    "op9_quality_rules": quality.SQL,
}
