"""Exact dedup as a stream: keyed state on disk keeps digest, best document and where its content lies; hits are compared in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talus.llm.common import new_path, written

SPACE = r"[\x20\x09-\x0D]+"
STATE = "spark.sql.streaming.stateStore"
#: State on disk, small commits, and no space set aside for what many small stores never write.
SETTINGS = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true", f"{STATE}.rocksdb.allowFAllocate": "false",
}
#: A group with at least one in so many of all rows is dealt out; there are at most as many such groups.
SHARES = 1000


def _rows(docs: DataFrame, digits: int) -> DataFrame:
    """key, digest, norm, at: the normalised text with its digest, and the place that a document has in its group.

    ``at`` orders as the rule does: most code points, then smallest doc_id with nulls last, then file and row, which are
    the locator of its content.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    norm = F.regexp_replace(text, SPACE, "")
    at = F.struct(
        (-F.char_length(text)).cast("long").alias("shorter"), F.col("doc_id").isNull().alias("without"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    rows = docs.select(F.sha2(norm, 256).alias("digest"), norm.alias("norm"), at.alias("at"))
    return rows.withColumn("key", F.substring("digest", 1, digits))


def _glob(path: str) -> str:
    """``path`` as a pattern that only it matches; a stream takes a single file by pattern only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def ingest(spark: SparkSession, path: str, schema: T.StructType, folder: str, files: int = 1000, digits: int = 64) -> DataFrame:
    """Stream the Parquet files of ``path`` that ``folder`` hasn't seen into its state, and give the state as a written table: key, best, size.

    The state is a streaming aggregation in RocksDB, without watermark, so no key ever expires; it lies in the shared
    folder, survives lost executors and is taken up again by a later call, which reads new files only. Rows of a key are
    combined in their tasks before they meet. ``files`` are read a micro-batch. The number of state partitions is that of
    spark.sql.shuffle.partitions at the first call and stays.
    """
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(_glob(path))
        groups = _rows(source, digits).groupBy("key").agg(F.min("at").alias("best"), F.count("*").alias("size"))
        query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
        query.awaitTermination()
        return written(state(spark, folder), "groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The keyed state as a table: key, best (the document that stays and its locator), size."""
    return spark.read.format("statestore").load(folder).select("key.key", F.col("value.min").alias("best"), F.col("value.count").alias("size"))


def _compared(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with best and size of their group, and whether their whole text equals the best document's.

    Rows of a group meet its best document's text in one partition; a group of a thousandth of all rows or more is dealt
    over several, each of which gets that one text: at most 2 * SHARES copies of texts.
    """
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = F.when(F.col("size") * SHARES >= total, F.ceil(F.col("size") * SHARES / F.lit(max(1, total)))).otherwise(1).cast("int")
    sized = groups.withColumn("parts", parts)
    heavy = sized.where(F.col("parts") > 1).select("key", F.col("parts").alias("_parts"), F.col("best").alias("_best"))  # fewer than SHARES rows
    own = F.pmod(F.xxhash64("at.file", "at.row"), F.col("_parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("_parts") - 1)
    dealt = rows.join(F.broadcast(heavy), "key", "left")
    dealt = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("part", F.explode(F.when(_same_place(F.col("at"), F.col("_best")), everywhere).otherwise(F.array("_own"))))
    known = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "part", "best", "size")
    met = dealt.join(known, ["key", "part"])
    first = Window.partitionBy("key", "part").orderBy(F.desc(_same_place(F.col("at"), F.col("best")))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("same", F.col("norm") == F.first("norm").over(first))
    return met.where("part = _own").select("key", "digest", "at", "best", "size", "same")


def _same_place(a: Column, b: Column) -> Column:
    return F.coalesce((a["file"] == b["file"]) & (a["row"] == b["row"]), F.lit(False))


def decide(docs: DataFrame, groups: DataFrame, digits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``, whose groups the state holds.

    Every hit is compared with the whole text of its group's best document. Texts that only share the digest's digits
    are grouped anew among themselves, round after round, until each group has one text; with all 64 digits of SHA-256
    that has never been seen to happen.
    """
    rows = _rows(docs, digits)
    out, left = None, rows
    while True:
        compared = written(_compared(left, groups), "compared")
        other = compared.where("not same")
        mixed = not other.isEmpty()
        equal = compared.where("same")
        if mixed:  # the state counted other texts with them
            sizes = equal.groupBy("key").agg(F.count("*").alias("_size"))
            equal = equal.join(sizes, "key").withColumn("size", F.col("_size"))
        here = equal.select(
            F.col("at.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), _same_place(F.col("at"), F.col("best")).alias("kept"),
            F.col("digest").alias("text_sha256"))
        out = here if out is None else out.unionByName(here)
        if not mixed:
            return out
        groups = written(other.groupBy("key").agg(F.min("at").alias("best"), F.count("*").alias("size")), "groups")
        places = other.select(F.col("at.file").alias("_file"), F.col("at.row").alias("_row"))
        left = rows.join(places, (rows["at"]["file"] == F.col("_file")) & (rows["at"]["row"] == F.col("_row")), "left_semi")


def dedup(spark: SparkSession, path: str, folder: str | None = None, files: int = 1000, digits: int = 64) -> DataFrame:
    """One row for each document of the Parquet files of ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so without ASCII white space; the row with most code points stays, then the smallest
    doc_id, nulls last; of repeated doc_ids with equal texts the first by file and row. Null texts are empty ones and
    empty ones are equal; no files give no rows; other columns are ignored. ``folder`` keeps the state for later calls.
    """
    docs = spark.read.parquet(path)
    folder = folder or new_path(spark, "dedup-state")
    schema = T.StructType([f for f in docs.schema if f.name in ("doc_id", "text")])
    groups = ingest(spark, path, schema, folder, files, digits)
    return decide(docs, groups, digits)


#: DuckDB SQL of ``dedup``.
ORACLE = r"""
with rows as (
  select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by norm) as group_size, row_number() over best = 1 as kept, sha256(norm) as text_sha256
from rows
window best as (partition by norm order by length(text) desc, doc_id nulls last rows between unbounded preceding and unbounded following)
"""
