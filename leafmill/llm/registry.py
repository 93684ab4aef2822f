"""Queries of the training-text operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bloom_lm, near_dup, oracles, pfair_mix, phrases, prefix_trie, quality_rules, quotation, span_crf, suffix_repeats, toxic_sentences, url_terms, weak_quality, wu_manber
from leafmill.tables import table


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_terms.judge_urls(table(spark, sf_dir, "pages"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components_of(table(spark, sf_dir, "documents"), words=2)


def op5_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.build_chats(table(spark, sf_dir, "conversations"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix.mix(docs).select("doc_id", "source", "block", "slot", "place")


def op7_span_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_crf.find_personal_data(table(spark, sf_dir, "documents"))


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


def op11_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_sentences.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_prefixes(table(spark, sf_dir, "conversations")).drop("turn_id")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_repeats, op2_quality_rules, op3_url_filter, op4_minhash, op5_quotation, op6_pfair_mix, op7_span_crf, op8_bloom_lm, op9_decontaminate, op10_weak_quality, op11_toxic_sentences, op12_prefix_trie, op13_phrases)}
ORACLES: dict[str, str] = oracles.SQL
