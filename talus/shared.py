"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on one machine a temporary folder where it is unset; a cluster without it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='talus-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "sessions") -> str:
    return f"{shared_dir(spark)}/talus/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "tables") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def make_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


#: Schemes whose files a task opens by itself. Files of others are read by Spark alone.
OPENED = ("file", "hdfs", "s3", "gs")


def local_path(path: str) -> str | None:
    """The place of a ``file:`` path on a mounted disk, None for another scheme."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return re.sub("^/+", "/", rest) if scheme == "file" else None


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """A file of the shared store to read from, in a task. Only ``file:`` is covered by tests here."""
    place = local_path(path)
    if place is None:
        store, place = fs.FileSystem.from_uri(quote(path, safe=":/"))
        with store.open_input_stream(unquote(place)) as stream:
            yield io.BufferedReader(stream, 1 << 20)
    else:
        with open(place, "rb", 1 << 20) as stream:
            yield stream


@contextmanager
def put(path: str) -> Iterator[BinaryIO]:
    """A file of the shared store to write to, in a task: it is there whole or not at all, and a repeated task replaces it."""
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    place = local_path(path)
    if place is None:
        store, to = fs.FileSystem.from_uri(quote(path, safe=":/"))
        _, beside = fs.FileSystem.from_uri(quote(aside, safe=":/"))
        with store.open_output_stream(unquote(beside)) as stream:
            yield stream
        store.move(unquote(beside), unquote(to))
    else:
        os.makedirs(local_path(folder), exist_ok=True)
        with open(local_path(aside), "wb", 1 << 20) as stream:
            yield stream
        os.replace(local_path(aside), place)
