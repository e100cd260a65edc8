"""Token totals by source, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import deleted, shuffles_freed, text_batches, written

#: Where the vocabulary files lie on every machine; a parameter of whatever counts tokens.
FOLDER = "/opt/tokenizers"
#: Fixed: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUP = ["source", "lang", "tokenizer"]
CHANGES = ("insert", "delete", "revise")
SYMBOLS = r"[#*$%&|<>]+"


@lru_cache(maxsize=8)
def counter(version: str, folder: str) -> Callable[[str], int]:
    """How a tokenizer version counts: ``words-1`` or the ranks of ``<folder>/<version>.tiktoken``."""
    if version == "words-1":
        return lambda text: len(text.encode().split())
    import tiktoken

    with open(f"{folder}/{version}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def delta(changes: DataFrame, versions: tuple[str, ...], folder: str = FOLDER) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens): the signed sums of a batch of changes.

    changes: change (insert, delete or revise), source, lang, text, old_text. An insert adds its text, a delete takes
    away its old_text, a revision does both. Null texts count as empty; null sources and languages are groups of their
    own; other changes fail. Tokens are summed per task before they are shuffled.
    """
    text_batches(changes.sparkSession)
    known = F.col("change").isin(*CHANGES)
    checked = F.when(known, F.col("change")).otherwise(F.raise_error(F.concat(F.lit("not a change: "), F.coalesce("change", F.lit("null")))))
    rows = changes.select(checked.alias("change"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text", "old_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {v: counter(v, folder) for v in versions}
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for change, source, lang, new, old in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                signed = [(1, new or "")] * (change != "delete") + [(-1, old or "")] * (change != "insert")
                for sign, text in signed:
                    for v in versions:
                        s = sums.setdefault((source, lang, v), [0, 0])
                        s[0] += sign
                        s[1] += sign * count[v](text)
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=[*GROUP, "docs", "tokens"])

    sums = rows.mapInArrow(run, "source string, lang string, tokenizer string, docs long, tokens long")
    return sums.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenTotals:
    """Totals as the sum of committed batches in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.makeQualified(self._path(self.folder)).toUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._never_onto_another = spark.sparkContext._gateway.new_array(rename, 1)
        self._never_onto_another[0] = rename.NONE

    def _final(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.folder}/batches/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._store.exists(self._path(self._final(batch)))

    def commit(self, batch: str, sums: DataFrame) -> bool:
        """Add a batch's signed sums once. A batch that is there already changes nothing and gives False.

        The sums are staged in a folder of their own and come in by one rename that fails where its target exists. So a
        job that dies midway leaves the totals as they were and can run again under the same name, and of two committers
        of a name one gets False.
        """
        final = self._final(batch)
        if self.committed(batch):
            return False
        staged = f"{self.folder}/staged/{batch}-{uuid.uuid4().hex}"
        with shuffles_freed(self.spark):
            sums.select(*GROUP, "docs", "tokens").write.parquet(staged)  # adaptive plans join small partitions, large ones stay apart
        self._store.mkdirs(self._path(f"{self.folder}/batches"))
        try:
            self._context.rename(self._path(staged), self._path(final), self._never_onto_another)
        except Py4JJavaError as error:
            deleted(self.spark, staged)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all batches; groups that are back to nothing have no row."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        if not self._store.exists(self._path(f"{self.folder}/batches")):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", batch string").parquet(f"{self.folder}/batches")
        summed = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 or tokens <> 0")


def inserts(docs: DataFrame) -> DataFrame:
    """All documents as changes of a first batch."""
    return docs.select(F.lit("insert").alias("change"), "source", "lang", "text", F.lit(None).cast("string").alias("old_text"))


def ledger(docs: DataFrame, revised: Column, versions: tuple[str, ...], folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, new_tokens): each document's counts, and those of its text as ``revised``.

    Texts are counted in their row; what is shuffled later are counts. Only a revision that differs is counted again.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    new = F.coalesce(revised, F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"), F.when(new != text, new).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(v, folder) for v in versions]
        for batch in batches:
            old = [[n(t) for n in count] for t in batch.column(3).to_pylist()]
            new = [o if t is None else [n(t) for n in count] for o, t in zip(old, batch.column(4).to_pylist(), strict=True)]
            for k, version in enumerate(versions):
                counts = [pa.array([o[k] for o in side], pa.int64()) for side in (old, new)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array([version] * batch.num_rows), *counts], names=["doc_id", *GROUP, "tokens", "new_tokens"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long, new_tokens long")


def count_all(docs: DataFrame, labels: DataFrame, versions: tuple[str, ...], folder: str) -> DataFrame:
    """Totals of all documents after what their labels change: toxic ones go, those of low quality are written anew without SYMBOLS.

    labels: doc_id, quality, toxic; of several rows of a document the worst holds. Documents without a label and null ids
    stay as they are. Two batches, the inserts and the signed changes, are each committed again without effect.
    """
    counts = written(ledger(docs, F.regexp_replace(F.col("text").cast("string"), SYMBOLS, " "), versions), "token-ledger")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).where("toxic = 1 or quality = 0")
    gone = F.coalesce(F.col("toxic") == 1, F.lit(False))
    changed = counts.join(known, counts.doc_id == known["_id"]).select(
        *GROUP, F.when(gone, -1).otherwise(0).alias("docs"), F.when(gone, -F.col("tokens")).otherwise(F.col("new_tokens") - F.col("tokens")).alias("tokens"))
    totals = TokenTotals(docs.sparkSession, folder)
    for name, rows in (("documents-1", counts.select(*GROUP, F.lit(1).alias("docs"), "tokens")), ("labels-1", changed)):
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").alias("tokens"))
        totals.commit(name, sums)
        totals.commit(name, sums)
    return totals.totals()


#: DuckDB SQL of ``count_all`` with the version words-1.
ORACLE = r"""
with counted as (
  select d.source, d.lang, l.toxic, l.quality,
         len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) as old,
         len(regexp_extract_all(regexp_replace(coalesce(d.text, ''), '[#*$%&|<>]+', ' ', 'g'), '[^\x20\x09-\x0D]+')) as new
  from documents d left join labels l on d.doc_id = l.doc_id
)
select source, lang, 'words-1' as tokenizer, cast(count(*) as bigint) as docs,
       cast(sum(case when quality = 0 then new else old end) as bigint) as tokens
from counted where toxic is distinct from 1 group by source, lang
"""
