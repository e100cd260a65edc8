"""All readers by the name of their source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.schemas import CONVERSATION, MESSAGE, ensure_columns
from talus.sources import tool_a, tool_b, tool_c, tool_d, tool_e


@dataclass(frozen=True)
class Reader:
    """scan: (spark, **where) -> metas; parse: (spark, metas, **where) -> (conversations, messages)."""

    scan: Callable[..., DataFrame]
    parse: Callable[..., tuple[DataFrame, DataFrame]]


_readers: dict[str, Reader] = {}


def register(source: str, reader: Reader) -> None:
    """Known from now on; a later reader of the same source replaces it."""
    _readers[source] = reader


def _tool_b_parse(spark: SparkSession, metas: DataFrame, root: str, index_file: str | None = None):
    return tool_b.parse(spark, metas, tool_b.titles(spark, index_file) if index_file else None)


register(tool_a.SOURCE, Reader(lambda spark, root: tool_a.scan(spark, root), lambda spark, metas, root: tool_a.parse(spark, metas)))
register(tool_b.SOURCE, Reader(lambda spark, root, index_file=None: tool_b.scan(spark, root), _tool_b_parse))
register(tool_c.SOURCE, Reader(tool_c.scan, lambda spark, metas, workspaces, global_file: tool_c.parse(spark, metas, global_file)))
register(tool_d.SOURCE, Reader(tool_d.scan, tool_d.parse))
register(tool_e.SOURCE, Reader(tool_e.scan, lambda spark, metas, workspaces, global_folder=None: tool_e.parse(spark, metas)))


def readers() -> dict[str, Reader]:
    return dict(_readers)


def scan_all(spark: SparkSession, places: dict[str, dict[str, str]]) -> DataFrame:
    """Metas of all sources in ``places`` (source -> where its files are)."""
    return reduce(DataFrame.unionByName, [_readers[source].scan(spark, **where) for source, where in places.items()])


def descriptors(metas: DataFrame) -> DataFrame:
    """(source, conversations): how many sessions each source has."""
    return metas.groupBy("source").agg(F.count("*").alias("conversations"))


def parse_all(spark: SparkSession, metas: DataFrame, places: dict[str, dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of all sessions in metas, in the model's columns."""
    parsed = [_readers[source].parse(spark, metas.where(F.col("source") == source), **where) for source, where in places.items()]
    conversations = reduce(DataFrame.unionByName, [ensure_columns(c, CONVERSATION).select(*CONVERSATION.names) for c, _ in parsed])
    messages = reduce(DataFrame.unionByName, [ensure_columns(m, MESSAGE).select(*MESSAGE.names) for _, m in parsed])
    return conversations, messages
