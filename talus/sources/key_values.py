"""Tools that keep their state in SQLite key-value files: (file_path, key, value) rows, read by ranges of rows."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.shared import local_path

#: Fixed value: the tables that hold keys and values.
TABLES = ("ItemTable", "cursorDiskKV")
SCHEMA = "file_path string, key string, value string, unreadable string"
#: Row numbers of a range that a task reads, and what leaves it at a time: so many rows, or so many characters of values.
SPAN, BATCH, CHARS = 20_000, 1_000, 1 << 24


def _image(content: bytes) -> bytearray:
    """A database's bytes, with its header saying that no log lies beside it: what was read is one file at one time."""
    image = bytearray(content)
    image[18:20] = b"\x01\x01"
    return image


def _prefixed(prefix: str) -> tuple[str, tuple]:
    return (" where key >= ? and key < ?", (prefix, prefix[:-1] + chr(ord(prefix[-1]) + 1))) if prefix else (" where true", ())


def _rows(db: sqlite3.Connection, table: str, prefix: str, span: tuple[int, int] | None = None) -> Iterator[pd.DataFrame]:
    """Keys and values, looked up by the prefix of keys and by a span of row numbers, some at a time."""
    where, given = _prefixed(prefix)
    if span:
        where, given = f"{where} and rowid between ? and ?", (*given, *span)
    rows, held = [], 0
    for key, value in db.execute(f"select key, value from {table}{where}", given):
        rows.append((key, value.decode("utf-8", "replace") if isinstance(value, bytes) else value))
        held += len(value or "")
        if len(rows) >= BATCH or held >= CHARS:
            yield pd.DataFrame(rows, columns=["key", "value"])
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["key", "value"])


def _at(path: str) -> sqlite3.Connection:
    """The file where it lies: pages are read as they are needed, and what a log beside it holds is not."""
    return sqlite3.connect(f"file:{quote(local_path(path))}?mode=ro&immutable=1", uri=True)


def _refused(path: str, error: sqlite3.Error) -> pd.DataFrame:
    return pd.DataFrame({"file_path": [path], "key": [None], "value": [None], "unreadable": [str(error)]})


def _ranged(spark: SparkSession, files: DataFrame, table: str, prefix: str) -> DataFrame:
    """Rows of files on disks that all machines see: ranges of row numbers are listed first, then dealt over tasks.

    Of the keys with the prefix only the first and the last row are looked up for that, in the index of keys where there is one.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["file_path"]:
                try:
                    with closing(_at(path)) as db:
                        where, given = _prefixed(prefix)
                        least, most = db.execute(f"select min(rowid), max(rowid) from {table}{where}", given).fetchone()
                except sqlite3.Error as error:
                    yield pd.DataFrame({"file_path": [path], "first": [0], "last": [0], "refused": [str(error)]})
                else:
                    starts = range(least, most + 1, SPAN) if most is not None else ()
                    for at in range(0, len(starts), BATCH):
                        some = starts[at : at + BATCH]
                        yield pd.DataFrame({"file_path": path, "first": list(some), "last": [s + SPAN - 1 for s in some], "refused": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, last, refused in batch.itertuples(index=False):
                if refused is not None:
                    yield _refused(path, refused)
                    continue
                try:
                    with closing(_at(path)) as db:
                        for rows in _rows(db, table, prefix, (first, last)):
                            yield rows.assign(file_path=path, unreadable=None)[["file_path", "key", "value", "unreadable"]]
                except sqlite3.Error as error:
                    yield _refused(path, error)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = files.repartition(tasks, "file_path").mapInPandas(ranges, "file_path string, first long, last long, refused string")
    return found.repartition(tasks, "file_path", "first").mapInPandas(run, SCHEMA)


def _in_memory(files: DataFrame, table: str, prefix: str) -> DataFrame:
    """Rows of files that only Spark opens: each file must fit its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with closing(sqlite3.connect(":memory:")) as db:
                        db.deserialize(bytes(_image(content)))
                        for rows in _rows(db, table, prefix):
                            yield rows.assign(file_path=path, unreadable=None)[["file_path", "key", "value", "unreadable"]]
                except sqlite3.Error as error:
                    yield _refused(path, error)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def every(spark: SparkSession, root: str, pattern: str, table: str, prefix: str = "") -> DataFrame:
    """(file_path, key, value, unreadable) of all files below ``root`` by name, or of the one file that ``root`` is.

    Files on mounted disks are read by ranges of 20,000 rows, so a file of any size is read by many tasks and none holds
    it; only keys with the prefix leave a task, some at a time. Files of other stores are opened in memory, one a task.
    A file that is no database gives one row that says so in ``unreadable``.
    """
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if files.where(~F.col("path").startswith("file:")).select("path").head(1):
        return _in_memory(files, table, prefix)
    return _ranged(spark, files.select(F.col("path").alias("file_path")), table, prefix)


def read(spark: SparkSession, root: str, pattern: str, table: str, prefix: str = "") -> DataFrame:
    """(file_path, key, value) of all readable files; ``unreadable`` names the others."""
    return every(spark, root, pattern, table, prefix).where(F.col("unreadable").isNull()).drop("unreadable")


def unreadable(spark: SparkSession, root: str, pattern: str, table: str) -> DataFrame:
    """(file_path, unreadable): files that are no database of this kind, and why, to report after an import."""
    return every(spark, root, pattern, table, "\x00").where(F.col("unreadable").isNotNull()).select("file_path", "unreadable")
