"""Tool D: a key-value file a workspace with all its sessions in one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import file_uri_path, last_segment, trim_all
from talus.shared import written
from talus.sources import key_values
from talus.sources.common import FENCE, META, iso_millis, with_bounds

#: Fixed values.
SOURCE, STATE_FILE, KEY = "trae", "state.vscdb", "memento/icube-ai-agent-storage"
STORAGE = (
    "list array<struct<sessionId:string,createdAt:bigint,updatedAt:bigint,messages:array<struct<role:string,content:string,turnIndex:int,timestamp:bigint,"
    "agentMessageId:string,turnId:string,agentTaskContent:struct<proposal:string,proposalReasoningContent:string,guideline:struct<thought:string,"
    "planItems:array<struct<thought:string,toolName:string,reasoningContent:string>>>>>>>>"
)


def _sessions(spark: SparkSession, workspaces: str) -> DataFrame:
    rows = key_values.read(spark, workspaces, STATE_FILE, "ItemTable", KEY).where(F.col("key") == KEY)
    rows = rows.select("file_path", F.explode(F.from_json("value", STORAGE)["list"]).alias("s"))
    return rows.where(F.size("s.messages") > 0)


def scan(spark: SparkSession, workspaces: str) -> DataFrame:
    """Sessions with messages; their change mark is a hash of their own messages, not of the whole file."""
    folders = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json").text(workspaces, wholetext=True)
    folders = folders.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/workspace\.json$", 1).alias("hash"), F.get_json_object("value", "$.folder").alias("uri"))
    rows = _sessions(spark, workspaces).withColumn("hash", F.regexp_extract("file_path", r"([^/]+)/state\.vscdb$", 1)).join(folders, "hash", "left")
    content = F.to_json("s.messages")
    return rows.select(
        F.col("s.sessionId").alias("id"), F.lit(SOURCE).alias("source"), "file_path", F.length(content).cast("long").alias("file_size"),
        F.format_string("%016x", F.xxhash64(content)).alias("file_mtime"), F.coalesce(file_uri_path(F.col("uri")), F.lit("")).alias("project_dir"),
    )


def monotonic(real, start, position):
    """Times that never go back: the real one if later than the one before, else one millisecond more than that."""
    w = Window.partitionBy("conversation_id").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return F.col(position) + F.greatest(start, F.max(real - F.col(position)).over(w))


def parse(spark: SparkSession, metas: DataFrame, workspaces: str) -> tuple[DataFrame, DataFrame]:
    rows = _sessions(spark, workspaces).withColumn("id", F.col("s.sessionId")).join(metas.select("id"), "id", "left_semi")
    rows = rows.select("id", F.col("s.createdAt").alias("created"), F.posexplode("s.messages").alias("pos", "m")).where(F.col("m.role").isin("user", "assistant"))
    task, plan = F.col("m.agentTaskContent"), F.col("m.agentTaskContent.guideline.planItems")
    direct = trim_all(F.coalesce("m.content", F.lit("")))
    none = F.array().cast("array<string>")
    filled = lambda c: F.filter(F.array(c), lambda x: x.isNotNull() & (x != ""))
    finish = F.coalesce(F.transform(F.filter(plan, lambda i: (i["toolName"] == "finish") & (i["thought"] != "")), lambda i: i["thought"]), none)
    parts = F.concat(filled(task["proposal"]), finish)
    parts = F.when(F.size(parts) > 0, parts).otherwise(filled(task["guideline"]["thought"]))
    steps = F.coalesce(F.filter(F.transform(plan, lambda i: i["reasoningContent"]), lambda x: x.isNotNull() & (x != "")), none)
    thoughts = F.concat(filled(task["proposalReasoningContent"]), steps)
    replying = (F.col("m.role") == "assistant") & (direct == "")
    rows = rows.select(
        F.col("id").alias("conversation_id"), F.coalesce(F.nullif("m.agentMessageId", F.lit("")), F.nullif("m.turnId", F.lit("")), F.concat_ws("-", "id", "m.turnIndex")).alias("id"),
        F.col("m.role").alias("type"), F.when(replying, trim_all(F.array_join(parts, "\n\n"))).otherwise(direct).alias("content"),
        F.when(replying & (F.size(thoughts) > 0), F.array_join(thoughts, "\n")).alias("thinking"),
        ((F.col("m.role") == "assistant") & F.coalesce(F.exists(plan, lambda i: F.coalesce(i["toolName"], F.lit("")).isin("", "finish") == F.lit(False)), F.lit(False))).alias("has_tool_use"),
        F.coalesce("m.turnIndex", F.lit(0)).alias("turn"), "pos", F.coalesce("m.timestamp", F.lit(0)).cast("long").alias("real"), "created",
    )
    rows = written(rows, "parsed").where((F.col("content") != "") | F.col("thinking").isNotNull())  # files are read once
    rows = rows.withColumn("sort_order", (F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn", "pos")) - 1).cast("long"))
    ts = monotonic(F.col("real"), F.coalesce("created", F.lit(0)), "sort_order")
    messages = rows.select(
        "conversation_id", "id", F.lit(None).cast("string").alias("parent_uuid"), "type", F.col("type").alias("role"), "content", "has_tool_use",
        F.col("content").contains(FENCE).alias("has_code"), "thinking", iso_millis(ts).alias("timestamp"), "sort_order",
    )
    empty = F.lit(None).cast("string")
    conversations = metas.select(*META).withColumn("project_name", F.coalesce(last_segment(F.col("project_dir")), F.lit("")))
    conversations = conversations.withColumn("cwd", F.when(F.col("project_dir") != "", F.col("project_dir"))).withColumn("git_branch", empty).withColumn("slug", empty)
    return with_bounds(conversations, messages), messages
