"""What the readers share: whole files in line order, timestamps, and the shape of their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from talus.shared import OPENED, opened

FENCE = "```"
META = ["id", "source", "file_path", "file_size", "file_mtime", "project_dir"]
#: Bytes of lines that leave a task at a time.
BLOCK = 1 << 22


def files(spark: SparkSession, root: str, pattern: str, least_bytes: int = 0) -> DataFrame:
    """(file_path, file_size, file_mtime) of files below root by name; contents are not read."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        .select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), iso(F.col("modificationTime")).alias("file_mtime"))
    )
    return found.where(F.col("file_size") >= least_bytes)


def _by_spark(spark: SparkSession, metas: DataFrame) -> DataFrame:
    """metas with the text of their file, for stores that only Spark opens: the paths are listed by the driver."""
    paths = [r.file_path for r in metas.select("file_path").distinct().toLocalIterator()]
    if not paths:
        return metas.withColumn("text", F.lit(None).cast("string"))
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    # The two scans write a path's scheme, slashes and special characters in their own ways.
    name = lambda c: F.try_url_decode(F.regexp_replace(F.replace(F.col(c), F.lit("+"), F.lit("%2B")), "^file:/+", "/"))
    plain = F.regexp_replace("file_path", "^file:/+", "/")
    return metas.withColumn("_at", plain).join(texts.select(name("file_path").alias("_at"), "text"), "_at").drop("_at")


def _opened_by_tasks(metas: DataFrame) -> bool:
    scheme = F.regexp_extract("file_path", "^([A-Za-z0-9+.-]+):/", 1)
    return not metas.where(~scheme.isin("", *OPENED)).head(1)


def _through_files(spark: SparkSession, metas: DataFrame, name: str, kind: str, cut: Callable[[BinaryIO], Iterator[tuple[int, object]]]) -> DataFrame:
    """metas with (part, name) for every piece that ``cut`` makes of their file.

    The list of files stays a DataFrame, dealt over tasks by path; a task opens its files one after another and hands
    on a piece at a time, so neither the driver nor a task holds more paths or texts than that.
    """
    schema = T.StructType([*metas.schema.fields, T.StructField("part", T.LongType()), *T.StructType.fromDDL(f"{name} {kind}").fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("file_path").to_pylist()
            for at, path in enumerate(paths):
                with opened(path) as stream:
                    for part, piece in cut(stream):
                        values = [*batch.slice(at, 1).columns, pa.array([part], types.field("part").type), pa.array([piece], types.field(name).type)]
                        yield pa.RecordBatch.from_arrays(values, names=types.names)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return metas.repartition(tasks, "file_path").mapInArrow(run, schema)


def whole_texts(spark: SparkSession, metas: DataFrame) -> DataFrame:
    """metas with the text of their file. Only the listed files are read; each file is one session and one row."""
    if not _opened_by_tasks(metas):
        return _by_spark(spark, metas)
    return _through_files(spark, metas, "text", "string", lambda stream: [(0, stream.read().decode("utf-8", "replace"))]).drop("part")


def _blocks(stream: BinaryIO) -> Iterator[tuple[int, list[str]]]:
    """Lines of a file, some megabytes at a time, with the number of each block's first."""
    first, block, held = 0, [], 0
    for raw in stream:
        block.append(raw.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r"))
        held += len(raw)
        if held >= BLOCK:
            yield first, block
            first, block, held = first + len(block), [], 0
    if block:
        yield first, block


def file_lines(spark: SparkSession, metas: DataFrame) -> DataFrame:
    """metas with the lines of their file: line_no from 0, line; blank lines are left out. No task holds a whole file."""
    if not _opened_by_tasks(metas):
        return lines(_by_spark(spark, metas))
    cut = _through_files(spark, metas, "block", "array<string>", _blocks).select(*metas.columns, "part", F.posexplode("block").alias("at", "line"))
    return cut.where(F.trim("line") != "").select(*metas.columns, (F.col("part") + F.col("at")).cast("int").alias("line_no"), "line")


def lines(rows: DataFrame) -> DataFrame:
    """rows with their text cut into lines: line_no from 0, line; blank lines are left out."""
    cut = rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return cut.where(F.trim("line") != "")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_millis(millis: Column) -> Column:
    return iso(F.timestamp_millis(millis))


def numbered(messages: DataFrame, position: str) -> DataFrame:
    """messages with sort_order from 0 by time; equal times keep their place in the file."""
    w = Window.partitionBy("conversation_id").orderBy(F.to_timestamp("timestamp").asc_nulls_first(), position)
    return messages.withColumn("sort_order", (F.row_number().over(w) - 1).cast("long"))


def with_bounds(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations with message_count, first_message_at and last_message_at."""
    bounds = messages.groupBy(F.col("conversation_id").alias("id")).agg(
        F.count("*").alias("message_count"), F.min_by("timestamp", "sort_order").alias("first_message_at"), F.max_by("timestamp", "sort_order").alias("last_message_at")
    )
    return conversations.join(bounds, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("long"))


def first_seen(column: str, at: str = "line_no") -> Column:
    """The first non-empty value in file order."""
    value = F.when(F.col(column) != "", F.col(column))
    return F.min_by(value, F.when(value.isNotNull(), F.col(at))).alias(column)


def last_seen(column: str, at: str = "line_no") -> Column:
    value = F.when(F.col(column) != "", F.col(column))
    return F.max_by(value, F.when(value.isNotNull(), F.col(at))).alias(column)
