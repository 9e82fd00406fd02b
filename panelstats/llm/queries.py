"""The registered queries: each applies one operator, with production parameters, to its
whole table and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelstats.llm.common import table
from panelstats.llm import decontaminate as dec
from panelstats.llm import (conversations, html_extract, line_dedup, merkle, minhash, mixing, quality, secrets, topk, toxicity,
                            url_filter, warc)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_report(table(spark, sf_dir, "conversations"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_mixing, op3_line_dedup, op4_decontamination, op5_quality_rules, op6_secret_scan,
    op7_html_extraction, op8_minhash, op9_toxicity, op10_warc, op11_merkle_manifest, op12_conversation_repair,
    op13_exact_topk)}
