"""Incremental import: changed sessions only, in batches that can be repeated, driven by a timer or a file stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.schemas import CONVERSATION, MESSAGE
from talus.shared import written
from talus.sources.registry import parse_all, scan_all
from talus.store import Change, Store, changed

LEAST_MESSAGES = 2
#: What a changed session's file is recognised by.
MARKS = ["file_size", "file_mtime"]


def import_changes(spark: SparkSession, store: Store, places: dict[str, dict[str, str]]) -> dict[str, int]:
    """Import what is new or changed and return counts of outcomes: imported, skipped (too short), unchanged.

    Sessions are compared by (file, size, mtime) before any is read, so a log that grows is read again and one that
    doesn't is not; tools without a changed session are not read at all. Only parts of the tables that changed sessions fall in are written. A changed conversation and its messages are replaced together in one commit; notes stay. Running it
    again without changes commits nothing, so a batch that died can simply be repeated.
    """
    metas = scan_all(spark, places).cache()
    log = store.read("import_log")
    keys = ["source", "file_path"] + ["scan_id"]
    found = metas.withColumn("scan_id", F.col("id"))
    seen = log.select(*keys, *MARKS).distinct() if log is not None else spark.createDataFrame([], found.select(*keys, *MARKS).schema)
    new = changed(found, seen, keys, MARKS).cache()
    total, fresh = metas.count(), new.count()
    if not fresh:
        metas.unpersist()
        new.unpersist()
        return {"imported": 0, "skipped": 0, "unchanged": total}
    sources = {r.source for r in new.select("source").distinct().collect()}  # a row a tool
    conversations, messages = parse_all(spark, new.select(*metas.columns), {s: where for s, where in places.items() if s in sources})
    conversations = conversations.withColumn("status", F.lit("imported")).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    long_ones = conversations.where(F.col("message_count") >= LEAST_MESSAGES).dropDuplicates(["id"]).cache()
    kept = messages.join(long_ones.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select(*MESSAGE.names).dropDuplicates(["conversation_id", "id"])
    kept = written(kept, "imported")  # the commit looks at them more than once, and files are slow to read
    entries = new.select(F.concat_ws("\n", *keys).alias("log_key"), *keys, *MARKS, F.current_timestamp().alias("created_at"))
    imported = long_ones.count()
    ids = long_ones.select("id")
    store.commit({}, {
        "conversations": Change(long_ones.select(*CONVERSATION.names), ids, "id"), "messages": Change(kept, ids.withColumnRenamed("id", "conversation_id"), "conversation_id"),
        "import_log": Change(entries, entries.select("log_key"), "log_key"),
    })
    for df in (metas, new, long_ones):
        df.unpersist()
    return {"imported": imported, "skipped": fresh - imported, "unchanged": total - fresh}


def watch(spark: SparkSession, store: Store, places: dict[str, dict[str, str]], every: float = 3.0, rounds: int | None = None, report: Callable[[dict], None] = print) -> None:
    """Import on a timer, one run at a time; changes during a run are found by the next. Ends after ``rounds`` if given."""
    done = 0
    while rounds is None or done < rounds:
        began = time.monotonic()
        report(import_changes(spark, store, places))
        done += 1
        if rounds is None or done < rounds:
            time.sleep(max(0.0, every - (time.monotonic() - began)))


def stream_new_files(spark: SparkSession, root: str, pattern: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "3 seconds"):
    """A streaming query that hands each micro-batch of new files (path, text, batch id) to ``handle``.

    The file source sees each path once: use ``import_changes`` for files that grow. ``handle`` must be idempotent by
    batch id, since the batch that was running when the query stopped comes again.
    """
    rows = (
        spark.readStream.schema("value string").format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(root).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    )
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
