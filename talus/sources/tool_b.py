"""Tool B: one JSON-lines file of events per session, and an index of titles beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import last_segment, trim_all
from talus.sources.common import FENCE, META, file_lines, files, iso, last_seen, lines, numbered, with_bounds

#: Fixed values.
SOURCE, LEAST_BYTES, MARKER = "codex", 50, "## My request for Codex:\n"
NAME = r"rollout-\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-(.+)$"
LINE = (
    "timestamp string, type string, payload struct<type:string,id:string,cwd:string,git:struct<branch:string>,message:string,role:string,"
    "content:array<struct<type:string,text:string>>>"
)


def scan(spark: SparkSession, root: str) -> DataFrame:
    found = files(spark, root, "rollout-*.jsonl", LEAST_BYTES)
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.jsonl$", "")
    id_ = F.regexp_extract(name, NAME, 1)
    return found.select(F.when(id_ != "", id_).otherwise(name).alias("id"), F.lit(SOURCE).alias("source"), "file_path", "file_size", "file_mtime", F.lit("").alias("project_dir"))


def titles(spark: SparkSession, index_file: str) -> DataFrame:
    """(id, slug) of the index; of several lines of an id the last counts."""
    rows = lines(spark.read.text(index_file, wholetext=True).select(F.col("value").alias("text")))
    rows = rows.select("line_no", F.from_json("line", "id string, thread_name string").alias("x")).where(F.col("x.id") != "")
    return rows.groupBy(F.col("x.id").alias("id")).agg(F.max_by("x.thread_name", "line_no").alias("slug"))


def told_twice(group: str, order: str, value: str) -> Column:
    """Whether a row's value is that of the row before it in its group."""
    return F.coalesce(F.lag(value).over(Window.partitionBy(group).orderBy(order)) == F.col(value), F.lit(False))


def marked_by_followers(rows: DataFrame, group: str, order: str, head: Column, mark: Column, name: str) -> DataFrame:
    """rows with ``name``: whether a head has a mark between itself and the group's next head; false for what is no head."""
    nth = F.count_if(head).over(Window.partitionBy(group).orderBy(order))
    rows = rows.withColumn("_head", head).withColumn("_mark", mark).withColumn("_nth", nth)
    met = F.max(F.when(F.col("_mark"), 1).otherwise(0)).over(Window.partitionBy(group, "_nth")) == 1
    return rows.withColumn(name, met & F.col("_head")).drop("_head", "_mark", "_nth")


def parse(spark: SparkSession, metas: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages). The session's own id is the conversation's; that of the file name stands in for it."""
    rows = file_lines(spark, metas.select(*META))
    rows = rows.select(*META, "line_no", F.from_json("line", LINE, {"mode": "PERMISSIVE"}).alias("x")).where(F.col("x.payload").isNotNull())
    p = F.col("x.payload")
    kind = (
        F.when(F.col("x.type") == "session_meta", "meta")
        .when((F.col("x.type") == "event_msg") & (p["type"] == "user_message"), "user")
        .when((F.col("x.type") == "event_msg") & (p["type"] == "agent_message"), "agent")
        .when((F.col("x.type") == "response_item") & (p["type"] == "message") & (p["role"] == "assistant"), "response")
        .when((F.col("x.type") == "response_item") & p["type"].isin("function_call", "custom_tool_call"), "call")
    )
    raw = F.coalesce(p["message"], F.lit(""))
    asked = trim_all(F.when(F.instr(raw, MARKER) > 0, F.substring_index(raw, MARKER, -1)).otherwise(raw))
    parts = F.transform(F.filter(p["content"], lambda b: (b["type"] == "output_text") & (b["text"] != "")), lambda b: b["text"])
    text = F.when(F.col("kind") == "user", asked).when(F.col("kind") == "agent", raw).when(F.col("kind") == "response", trim_all(F.array_join(parts, "\n")))
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("content", text)
    rows = rows.where(~F.col("kind").isin("user", "agent", "response") | (trim_all(F.coalesce("content", F.lit(""))) != ""))
    about = rows.where("kind = 'meta'").select(*META, "line_no", F.col("x.payload.id").alias("own_id"), F.col("x.payload.cwd").alias("cwd"), F.col("x.payload.git.branch").alias("git_branch"))
    about = about.groupBy("file_path").agg(last_seen("own_id"), last_seen("cwd"), last_seen("git_branch"))
    # A response that repeats the last assistant text before it is the same message told twice.
    replies = rows.where(F.col("kind").isin("agent", "response"))
    replies = replies.withColumn("told", told_twice("file_path", "line_no", "content")).where((F.col("kind") == "agent") | ~F.col("told")).drop("told")
    events = replies.unionByName(rows.where(F.col("kind").isin("user", "call")))
    # Calls mark the assistant message before them.
    said = marked_by_followers(events, "file_path", "line_no", F.col("kind").isin("agent", "response"), F.col("kind") == "call", "has_tool_use").where("kind <> 'call'")
    said = said.join(about.select("file_path", "own_id"), "file_path", "left")
    id_ = F.coalesce("own_id", "id")
    role = F.when(F.col("kind") == "user", "user").otherwise("assistant")
    messages = said.select(
        id_.alias("conversation_id"), F.concat_ws(":", id_, F.col("line_no")).alias("id"), F.lit(None).cast("string").alias("parent_uuid"), role.alias("type"),
        role.alias("role"), "content", "has_tool_use", F.col("content").contains(FENCE).alias("has_code"), F.lit(None).cast("string").alias("thinking"),
        F.coalesce(F.col("x.timestamp"), iso(F.current_timestamp())).alias("timestamp"), "line_no",
    )
    messages = numbered(messages, "line_no").drop("line_no")
    conversations = metas.select(*META).join(about, "file_path", "left").withColumn("id", F.coalesce("own_id", "id")).drop("own_id")
    folder = F.coalesce(F.when(F.col("project_dir") != "", F.col("project_dir")), "cwd", F.lit(""))
    conversations = conversations.withColumn("project_dir", folder).withColumn("project_name", F.coalesce(last_segment(F.col("project_dir")), F.lit("")))
    if index is None:
        return with_bounds(conversations.withColumn("slug", F.lit(None).cast("string")), messages), messages
    return with_bounds(conversations.join(index.select("id", "slug"), "id", "left"), messages), messages
