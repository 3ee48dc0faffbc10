"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, merkle, topk
from .common import table
from .conversations import damaged_report
from .edit_counts import edit_counts
from .html_extract import page_texts
from .language import language_report
from .lines import line_report
from .minhash_dedup import near_components
from .near_join import near_classes
from .packing import packed_digest
from .repair import ids_round_trip
from .toxicity import toxicity_report


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_round_trip(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_edit_counts": op2_edit_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_repair_ids": op6_repair_ids,
    "op7_packing": op7_packing,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_wrapper": op9_html_wrapper,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": topk.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_merkle_manifest": merkle.SQL,
}
