"""Cutting note texts into chunks at paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import trim_all

SIZE = 500


def chunk_array(text: Column, size: int = SIZE) -> Column:
    """Paragraphs packed greedily into chunks of at most ``size`` characters; a longer paragraph is a chunk of its own."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def add(acc: Column, para: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(para) + 2 > size) & (acc["now"] != "")
        joined = F.concat(acc["now"], F.when(acc["now"] != "", "\n\n").otherwise(""), para)
        return F.when(full, F.struct(para.alias("now"), F.concat(acc["done"], F.array(trim_all(acc["now"]))).alias("done"))).otherwise(
            F.struct(joined.alias("now"), acc["done"].alias("done"))
        )

    packed = F.aggregate(
        F.split(text, "\n\n+"), start, add, lambda acc: F.concat(acc["done"], F.filter(F.array(trim_all(acc["now"])), lambda x: x != ""))
    )
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def chunk(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(note_id, text) -> (note_id, chunk_index, chunk_text)."""
    return texts.select("note_id", F.posexplode(chunk_array(F.col("text"), size)).alias("chunk_index", "chunk_text"))
