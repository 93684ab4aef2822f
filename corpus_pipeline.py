"""From raw documents to a training mix: five stages, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import near_dup, pfair_mix, span_crf, weak_quality, wu_manber
from leafmill.tables import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label classifier rejects."""
    return weak_quality.drop_poor(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark window of ten words occurs."""
    return wu_manber.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts placeholders where texts hold personal data."""
    return span_crf.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its block, slot and place in the mix of the sources."""
    return pfair_mix.mix(docs)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("personal_data", hide_personal_data), ("mix", mix)]
#: Signatures, the classifier and the span model have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
