"""Tool C: a global key-value file of message bubbles, and one a workspace that lists its sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.text import file_uri_path, last_segment, trim_all
from talus.sources import key_values
from talus.sources.common import FENCE, META, iso, iso_millis, numbered, with_bounds

#: Fixed values.
SOURCE, STATE_FILE = "cursor", "state.vscdb"
BUBBLE = (
    "_v int, type int, text string, createdAt string, isAgentic boolean, toolResults array<string>, suggestedCodeBlocks array<string>, codeBlocks array<string>, "
    "allThinkingBlocks array<struct<thinking:string,text:string>>, thinking string, bubbleId string"
)
COMPOSERS = "allComposers array<struct<composerId:string,createdAt:bigint,name:string,lastUpdatedAt:bigint>>"


def _bubbles(spark: SparkSession, global_file: str) -> DataFrame:
    rows = key_values.read(spark, global_file, "*", "cursorDiskKV", "bubbleId:")
    return rows.select(F.split("key", ":")[1].alias("id"), "key", "value", F.xxhash64("key", "value").alias("mark"))


def scan(spark: SparkSession, workspaces: str, global_file: str) -> DataFrame:
    """Sessions of all workspaces, and orphans: ids with a bubble that says something but no workspace.

    All bubbles of an orphan are looked at. The change mark is a hash of the session's own bubbles, not of the file.
    """
    folders = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json").text(workspaces, wholetext=True)
    folders = folders.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/workspace\.json$", 1).alias("hash"), F.get_json_object("value", "$.folder").alias("uri"))
    heads = key_values.read(spark, workspaces, STATE_FILE, "ItemTable", "composer.composerData").where("key = 'composer.composerData'")
    heads = heads.select(F.regexp_extract("file_path", r"([^/]+)/state\.vscdb$", 1).alias("hash"), F.explode(F.from_json("value", COMPOSERS)["allComposers"]).alias("x"))
    bubbles = _bubbles(spark, global_file)
    marks = bubbles.groupBy("id").agg(F.sum(F.length("value")).alias("file_size"), F.format_string("%016x", F.bit_xor("mark")).alias("mark"))
    known = heads.join(folders, "hash").select(F.col("x.composerId").alias("id"), F.col("x.createdAt").alias("created"), file_uri_path(F.col("uri")).alias("project_dir"))
    spoken = bubbles.where(trim_all(F.get_json_object("value", "$.text")) != "").select("id")
    orphans = marks.join(known.select("id"), "id", "left_anti").join(spoken, "id", "left_semi")
    known = known.join(marks, "id", "left").select("id", "project_dir", "file_size", F.coalesce("mark", iso_millis(F.col("created"))).alias("file_mtime"))
    rows = known.unionByName(orphans.select("id", F.lit("").alias("project_dir"), "file_size", F.col("mark").alias("file_mtime")))
    return rows.select("id", F.lit(SOURCE).alias("source"), F.lit(global_file).alias("file_path"), "file_size", "file_mtime", "project_dir")


def parse(spark: SparkSession, metas: DataFrame, global_file: str) -> tuple[DataFrame, DataFrame]:
    rows = _bubbles(spark, global_file).join(metas.select("id"), "id", "left_semi")
    rows = rows.select("id", "key", F.from_json("value", BUBBLE, {"mode": "PERMISSIVE"}).alias("b")).where(F.col("b").isNotNull())
    role = F.when(F.col("b.type") == 1, "user").otherwise("assistant")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    text = trim_all(F.coalesce("b.text", F.lit("")))
    thoughts = F.filter(F.transform("b.allThinkingBlocks", lambda t: F.coalesce(F.when(t["thinking"] != "", t["thinking"]), t["text"], F.lit(""))), lambda t: t != "")
    thinking = F.when(some(F.col("b.allThinkingBlocks")), F.when(F.size(thoughts) > 0, F.array_join(thoughts, "\n"))).otherwise(F.when(F.col("b.thinking") != "", F.col("b.thinking")))
    rows = rows.select(
        F.col("id").alias("conversation_id"), F.coalesce(F.when(F.col("b.bubbleId") != "", F.col("b.bubbleId")), F.element_at(F.split("key", ":"), -1)).alias("id"),
        F.lit(None).cast("string").alias("parent_uuid"), role.alias("type"), role.alias("role"), text.alias("content"),
        (some(F.col("b.toolResults")) | F.coalesce("b.isAgentic", F.lit(False))).alias("has_tool_use"),
        (text.contains(FENCE) | some(F.col("b.codeBlocks")) | some(F.col("b.suggestedCodeBlocks"))).alias("has_code"),
        thinking.alias("thinking"), F.coalesce("b.createdAt", iso(F.current_timestamp())).alias("timestamp"), "key",
    ).where((F.col("type") == "user") | (F.col("content") != ""))
    messages = numbered(rows, "key").drop("key")
    none = F.lit(None).cast("string")
    conversations = metas.select(*META).withColumn("project_name", F.coalesce(last_segment(F.col("project_dir")), F.lit("")))
    conversations = conversations.withColumn("cwd", F.when(F.col("project_dir") != "", F.col("project_dir"))).withColumn("git_branch", none).withColumn("slug", none)
    return with_bounds(conversations, messages), messages
