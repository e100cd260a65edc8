"""Tool A: one JSON-lines file per session in a folder per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.text import blank, trim_all
from talus.shared import written
from talus.sources.common import FENCE, META, file_lines, files, first_seen, numbered, with_bounds

#: Fixed values.
SOURCE, LEAST_BYTES = "claude-code", 100
TAGS = (
    r"(?s)<system-reminder>.*?</system-reminder>", r"<command-name>[^<]*</command-name>", r"<command-message>[^<]*</command-message>",
    r"<command-args>[^<]*</command-args>", r"<local-command-stdout>[^<]*</local-command-stdout>", r"(?s)<local-command-caveat>.*?</local-command-caveat>",
)
LINE = (
    "uuid string, parentUuid string, type string, sessionId string, cwd string, gitBranch string, slug string, timestamp string, "
    "message struct<role:string,content:string>"
)
BLOCKS = "array<struct<type:string,text:string,thinking:string>>"


def scan(spark: SparkSession, root: str) -> DataFrame:
    found = files(spark, root, "*.jsonl", LEAST_BYTES)
    parts = F.split("file_path", "/")
    return found.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("id"), F.lit(SOURCE).alias("source"), "file_path", "file_size", "file_mtime",
        F.element_at(parts, -2).alias("project_dir"),
    ).where(F.size(F.split(F.regexp_replace("file_path", "^file:/+", "/"), "/")) == len(root.rstrip("/").removeprefix("file://").split("/")) + 2)


def sanitised(text: Column) -> Column:
    for tag in TAGS:
        text = F.regexp_replace(text, tag, "")
    return trim_all(text)


def project_name(folder: Column) -> Column:
    """What follows ``project`` or ``projects`` in a dash-encoded folder, else its last two parts."""
    parts = F.filter(F.split(folder, "-"), lambda x: x != "")
    marks = F.transform(parts, lambda p: F.lower(p).isin("project", "projects"))
    at = F.array_position(marks, F.lit(True)).cast("int")
    after = F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts), F.lit(1))), "-")
    return F.when((at > 0) & (at < F.size(parts)), after).when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "-")).otherwise(folder)


def parse(spark: SparkSession, metas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of the sessions in metas. Malformed lines, noise and empty messages are left out.

    Files are read and their lines cleaned once: what both results go by is written to the shared folder.
    """
    rows = file_lines(spark, metas.select(*META))
    rows = rows.select(*META, "line_no", F.inline(F.array(F.from_json("line", LINE, {"mode": "PERMISSIVE"}))))  # filters stay behind it, so a line is parsed once
    rows = rows.where(F.col("uuid").isNotNull() & (F.col("uuid") != "") & F.col("type").isin("user", "assistant"))
    content = F.col("message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, BLOCKS))
    texts = F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"])
    thoughts = F.transform(F.filter("blocks", lambda b: (b["type"] == "thinking") & (b["thinking"] != "")), lambda b: b["thinking"])
    rows = rows.withColumn("blocks", blocks)
    as_text = F.col("blocks").isNull()
    rows = rows.withColumn("clean", sanitised(F.when(as_text, F.coalesce(content, F.lit(""))).otherwise(F.array_join(texts, "\n"))))
    rows = rows.select(
        *META, "line_no", "uuid", "parentUuid", "type", F.col("message.role").alias("role"), "cwd", "gitBranch", "slug", "timestamp", F.col("clean").alias("content"),
        F.when(~as_text & (F.size(thoughts) > 0), F.array_join(thoughts, "\n")).alias("thinking"),
        F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_use"), F.lit(False)).alias("has_tool_use"),
        F.when(as_text, F.col("clean").contains(FENCE)).otherwise(F.exists(texts, lambda t: t.contains(FENCE))).alias("has_code"),
    )
    rows = written(rows, "parsed")
    about = rows.groupBy(*META).agg(first_seen("cwd"), first_seen("gitBranch"), first_seen("slug"))
    said = rows.where(~blank(F.col("content")) | F.col("thinking").isNotNull() | F.col("has_tool_use"))
    messages = numbered(
        said.select(
            F.col("id").alias("conversation_id"), F.col("uuid").alias("id"), F.col("parentUuid").alias("parent_uuid"), "type",
            F.coalesce("role", "type").alias("role"), "content", "has_tool_use", "has_code", "thinking", "timestamp", "line_no",
        ),
        "line_no",
    ).drop("line_no")
    conversations = metas.select(*META).join(about.select("file_path", "cwd", F.col("gitBranch").alias("git_branch"), "slug"), "file_path", "left")
    return with_bounds(conversations.withColumn("project_name", project_name(F.col("project_dir"))), messages), messages
