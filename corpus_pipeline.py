"""Corpus preparation: quality rules, near-dedup, decontamination, PII, mixing. Counts as part of ``talus.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm import decontam, mixing, pii, quality, simhash
from talus.llm.common import new_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_corpus(docs, weights=(3, 1, 2), share=1.5, most=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
]
#: Trained models, SimHash and shuffled blocks are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next.

    The result is the mixed corpus, sorted into slot order after the last read: slot, part, doc_id, source, epoch, words, text. Null texts fail the
    quality rules; empty tables pass through all stages and give no rows; extra columns of documents are kept up to the mix.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.orderBy("slot", "part")
