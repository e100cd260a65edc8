"""Tool E: one JSON file per session, or a JSON-lines file whose first line is the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.text import file_uri_path, last_segment, trim_all
from talus.sources.common import FENCE, META, files, iso_millis, numbered, whole_texts, with_bounds

#: Fixed values.
SOURCE, LEAST_BYTES = "copilot", 100
REQUESTS = "requests array<struct<requestId:string,timestamp:bigint,message:struct<text:string>,response:array<struct<kind:string,value:string>>>>"
SESSION = f"sessionId string, creationDate bigint, customTitle string, {REQUESTS}"
NESTED = f"struct<sessionId:string,creationDate:bigint,customTitle:string,{REQUESTS.replace('requests ', 'requests:')}>"
SNAPSHOT = f"kind int, v {NESTED}, {SESSION}"
TOOL_KINDS = ("toolInvocationSerialized", "prepareToolInvocation")


def scan(spark: SparkSession, workspaces: str, global_folder: str | None = None) -> DataFrame:
    """Session files of all workspaces, with the folder that workspace.json names, and of windows without one."""
    found = files(spark, workspaces, "*.{json,jsonl}", LEAST_BYTES).where(F.col("file_path").contains("/chatSessions/"))
    folders = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json").text(workspaces, wholetext=True)
    folders = folders.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/workspace\.json$", 1).alias("hash"), F.get_json_object("value", "$.folder").alias("uri"))
    found = found.withColumn("hash", F.regexp_extract("file_path", r"([^/]+)/chatSessions/", 1)).join(folders, "hash", "left")
    found = found.withColumn("project_dir", F.coalesce(file_uri_path(F.col("uri")), F.lit(""))).drop("hash", "uri")
    if global_folder:
        found = found.unionByName(files(spark, global_folder, "*.{json,jsonl}", LEAST_BYTES).withColumn("project_dir", F.lit("")))
    id_ = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.jsonl?$", "")
    return found.select(id_.alias("id"), F.lit(SOURCE).alias("source"), "file_path", "file_size", "file_mtime", "project_dir")


def parse(spark: SparkSession, metas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages). What isn't a snapshot (kind 0 or none), or can't be read, is a conversation without messages."""
    rows = whole_texts(spark, metas.select(*META))
    text = F.when(F.col("file_path").endswith(".json"), F.col("text")).otherwise(F.substring_index("text", "\n", 1))
    rows = rows.select(*META, F.from_json(text, SNAPSHOT, {"mode": "PERMISSIVE"}).alias("x"))
    plain = F.struct("x.sessionId", "x.creationDate", "x.customTitle", "x.requests")
    rows = rows.withColumn("s", F.when(F.col("x.kind").isNull() | (F.col("x.kind") == 0), F.coalesce("x.v", plain)))
    own_id = F.coalesce(F.nullif("s.sessionId", F.lit("")), "id")
    turns = rows.select(own_id.alias("conversation_id"), F.posexplode("s.requests").alias("pos", "r"))
    value = lambda b: F.coalesce(b["value"], F.lit(""))
    said = F.filter("r.response", lambda b: (b["kind"].isNull() | (b["kind"] == "text")) & (value(b) != ""))
    thought = F.filter("r.response", lambda b: (b["kind"] == "thinking") & (value(b) != ""))
    answer = trim_all(F.array_join(F.transform(said, lambda b: b["value"]), "\n"))
    thinking = F.when(F.size(thought) > 0, F.array_join(F.transform(thought, lambda b: b["value"]), "\n"))
    asked = trim_all(F.coalesce("r.message.text", F.lit("")))
    request, at = F.nullif("r.requestId", F.lit("")), F.col("r.timestamp")

    def row(kind: int, role: str, id_, content, tool, thinking, millis):
        return F.struct(
            F.lit(kind).alias("k"), id_.alias("id"), F.lit(role).alias("type"), content.alias("content"), tool.alias("has_tool_use"),
            thinking.alias("thinking"), iso_millis(millis).alias("timestamp"),
        )

    none, tools = F.lit(None).cast("string"), F.coalesce(F.exists("r.response", lambda b: b["kind"].isin(*TOOL_KINDS)), F.lit(False))
    both = F.array(
        row(0, "user", F.coalesce(request, F.concat(F.lit("user-"), at)), asked, F.lit(False), none, at),
        row(1, "assistant", F.concat(F.lit("resp-"), F.coalesce(request, at.cast("string"))), F.coalesce(answer, F.lit("")), tools, thinking, at + 1),
    )
    turns = turns.select("conversation_id", "pos", F.explode(both).alias("m")).where((F.col("m.content") != "") | F.col("m.thinking").isNotNull())
    turns = turns.select(
        "conversation_id", "m.id", none.alias("parent_uuid"), "m.type", F.col("m.type").alias("role"), "m.content", "m.has_tool_use",
        F.col("m.content").contains(FENCE).alias("has_code"), "m.thinking", "m.timestamp", (F.col("pos") * 2 + F.col("m.k")).alias("place"),
    )
    messages = numbered(turns, "place").drop("place")
    conversations = rows.select(
        own_id.alias("id"), *META[1:], F.nullif("s.customTitle", F.lit("")).alias("slug"), F.coalesce(last_segment(F.col("project_dir")), F.lit("Global")).alias("project_name"),
        F.nullif("project_dir", F.lit("")).alias("cwd"), none.alias("git_branch"),
    )
    return with_bounds(conversations, messages), messages
