"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cityportrait.llm import conversations, host_rules, html, licenses, lm, media, mixing, neardup, negatives, pii, quality, spm, sql, warc
from cityportrait.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encoded(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality(table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality": op2_quality,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_html": op4_html,
        "op5_lm": op5_lm,
        "op6_licenses": op6_licenses,
        "op7_pii": op7_pii,
        "op8_host_rules": op8_host_rules,
        "op9_neardup": op9_neardup,
        "op10_media": op10_media,
        "op11_conversations": op11_conversations,
        "op12_negatives": op12_negatives,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_host_rules": sql.HOST_RULES,
        "op9_neardup": sql.NEAR_DUPLICATES,
        "op11_conversations": sql.CONVERSATIONS,
        "op12_negatives": sql.HARD_NEGATIVES,
        "op13_warc": sql.WARC,
    }
