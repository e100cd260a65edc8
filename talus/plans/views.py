"""The model's tables as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.vectors import with_norm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("sort_order"), F.col("role").alias("type"), F.col("text").alias("content"), F.lit(False).alias("has_tool_use"),
    )


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with code and tool use read off their length; every fourth only calls a tool and says nothing."""
    silent = F.col("sort_order") % 4 == 3
    rows = messages(spark, sf_dir).withColumn("has_code", F.length("content") % 5 == 0)
    rows = rows.withColumn("has_tool_use", silent | ((F.col("type") == "assistant") & (F.length("content") % 7 == 0)))
    return rows.withColumn("content", F.when(silent, "").otherwise(F.col("content")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks a note."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("long").alias("note_id"), (F.col("vec_id") % 2).cast("int").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("vec_id")).alias("chunk_text"), F.col("embedding").alias("vector"),
    )
    return with_norm(rows)


def vector_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the vectors; every seventh isn't embedded yet."""
    id_ = F.floor(F.col("vec_id") / 2).cast("long")
    rows = table(spark, sf_dir, "embeddings").groupBy(id_.alias("id")).agg(F.min("label").alias("label"))
    return rows.select("id", "label", F.when(F.col("id") % 7 == 3, "pending").otherwise("done").alias("embedding_status"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note points to two others."""
    notes = vector_notes(spark, sf_dir)
    n = notes.agg((F.max("id") + 1).alias("n"))
    rows = notes.crossJoin(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "n")  # n is one row
    target = (F.col("id") * F.when(F.col("k") == 0, 3).otherwise(5) + 7 + F.col("k")) % F.col("n")
    kind = F.when(F.col("k") == 0, "SIMILAR_TO").otherwise("LEADS_TO")
    return rows.select(
        (F.col("id") * 2 + F.col("k")).alias("id"), F.col("id").alias("source_note_id"), target.alias("target_note_id"), kind.alias("relation_type"),
        (F.lit(0.4) + (F.col("id") % 6) / 10.0).alias("confidence"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: source is the project, language the tag."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("c"), F.col("doc_id") % 50).alias("conversation_id"), F.left("text", F.lit(40)).alias("title"),
        F.col("text").alias("summary"), F.col("source").alias("project_name"), F.col("lang").alias("tag"), F.col("n_chars"),
    )
