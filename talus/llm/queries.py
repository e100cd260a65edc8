"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.llm import chat, decontam, divergence, html_text, licenses, mixing, pii, quality, search, simhash, stream_dedup, substrings, token_counts
from talus.llm.common import new_path, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, budget=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("n_lines")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a batch of inserts, then what labels delete and revise, each committed twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return token_counts.count_all(docs, labels, ("words-1", "byte_bpe_50k"), new_path(spark, "token-totals"))


def token_totals_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with the one tokenizer version that SQL can express."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return token_counts.count_all(docs, labels, ("words-1",), new_path(spark, "token-totals"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_in_batches(table(spark, sf_dir, "documents"), parts=(1 / 3, 2 / 3), window=20)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash_near_dedup, op2_quality_rules, op3_license_scan, op4_html_text, op5_token_counts, op6_substring_dedup,
        op7_mix_sources, op8_pii, op9_chat_rotation, op10_decontaminate, op11_lexical_search, op12_stream_dedup, op13_source_divergence, token_totals_of_words,
    )}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express; the others are tested against brute force."""
    return {"op3_license_scan": licenses.oracle(), "op9_chat_rotation": chat.ORACLE, "op11_lexical_search": search.ORACLE, "op12_stream_dedup": stream_dedup.ORACLE, "op13_source_divergence": divergence.ORACLE,
            "token_totals_of_words": token_counts.ORACLE}
