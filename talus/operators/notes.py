"""List, tag and status queries over conversations and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import contains_ci, contains_literal, first_non_blank

SYNTHETIC = "memory-writeback"
MOST_ROWS = 100
#: The agent that a source's conversations were held with.
AGENTS = {"codex": "codex", "claude-code": "claude", "copilot": "copilot", "cursor": "cursor", "trae": "trae"}


def conversation_filter(
    conversations: DataFrame, source: str | None = None, project: str | None = None, status: str | None = None, search: str | None = None, synthetic: str = SYNTHETIC
) -> DataFrame:
    """Conversations of a list query; those that hold only written-back memories are hidden."""
    keep: Column = F.col("source") != synthetic
    if source:
        keep = keep & (F.col("source") == source)
    if project:
        keep = keep & contains_ci(F.col("project_name"), project)
    if status:
        keep = keep & (F.col("status") == status)
    if search:
        keep = keep & (contains_ci(F.col("slug"), search) | contains_ci(F.col("project_name"), search))
    return conversations.where(keep)


def page(rows: DataFrame, by: str, key: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page, latest first, nulls last, ties by key. The limit is the feature: at most 100 rows."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    return rows.orderBy(F.col(by).desc_nulls_last(), key).offset(offset).limit(min(limit, MOST_ROWS))


def page_behind(rows: DataFrame, by: str, key: str, last: tuple | None = None, limit: int = 50) -> DataFrame:
    """The page behind the row whose (by, key) is ``last``, in the order of ``page``; the first page without one.

    Rows before it are left out by a filter that scans can push down, so of files and row groups written in that order
    only those that can hold the page are read, and a task keeps ``limit`` rows however deep the page lies. Rows that
    come in before ``last`` between two pages shift nothing. key must not be null.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    if last is not None:
        value, seen = last
        behind = F.col(key) > F.lit(seen)
        if value is None:
            rows = rows.where(F.col(by).isNull() & behind)
        else:
            rows = rows.where((F.col(by) < F.lit(value)) | ((F.col(by) == F.lit(value)) & behind) | F.col(by).isNull())
    return page(rows, by, key, limit=limit)


def note_filter(notes: DataFrame, note_tags: DataFrame | None = None, tag: str | None = None, search: str | None = None) -> DataFrame:
    if tag:
        notes = notes.join(note_tags.where(F.col("tag") == tag).select(F.col("note_id").alias("id")), "id", "left_semi")
    if search:
        notes = notes.where(contains_ci(F.col("title"), search) | contains_ci(F.col("summary"), search))
    return notes


def tags_of_notes(note_tags: DataFrame) -> DataFrame:
    """(note_id, tags): sorted names."""
    return note_tags.groupBy("note_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def with_tags(notes: DataFrame, note_tags: DataFrame) -> DataFrame:
    tags = tags_of_notes(note_tags).withColumnRenamed("note_id", "id")
    return notes.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_counts(tags: DataFrame, note_tags: DataFrame) -> DataFrame:
    """(tag, notes): how many notes have each tag, unused ones included, most used first."""
    used = note_tags.groupBy("tag").agg(F.count("note_id").alias("notes"))
    return tags.select("tag").join(used, "tag", "left").select("tag", F.coalesce("notes", F.lit(0)).cast("long").alias("notes")).orderBy(F.desc("notes"), "tag")


def tags_containing(tags: DataFrame, text: str) -> DataFrame:
    """Tags with ``text`` somewhere in their name, whatever its case; % and _ are themselves."""
    return tags.where(contains_literal(F.col("tag"), text))


def unsummarised(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("status").isin("imported", "error", "summarizing"))


def embedding_backlog(notes: DataFrame, active: DataFrame) -> DataFrame:
    """Notes that still need vectors, without those (id) whose task is queued or running."""
    return notes.where(F.col("embedding_status").isin("pending", "failed", "syncing")).join(active.select("id"), "id", "left_anti")


def title(project: Column, slug: Column, id_: Column) -> Column:
    return F.concat(project, F.lit(" / "), F.coalesce(F.when(slug != "", slug), F.left(id_, F.lit(8))))


def embedding_text(notes: DataFrame, note_tags: DataFrame) -> DataFrame:
    """(note_id, text): title, summary, conclusions, tags and snippet descriptions, parts parted by an empty line."""
    described = F.filter(F.transform("code_snippets", lambda s: s["description"]), lambda d: d.isNotNull() & (d != ""))
    tagged = with_tags(notes, note_tags)

    def part(a: Column, by: str) -> Column:
        return F.when(F.size(a) > 0, F.array_join(a, by))

    text = F.concat_ws("\n\n", "title", "summary", part(F.col("key_conclusions"), "\n"), part(F.col("tags"), " "), part(described, "\n"))
    return tagged.select(F.col("id").alias("note_id"), text.alias("text"))


def status_summary(conversations: DataFrame, notes: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: conversations, real_conversations (no demo rows), notes, tags, is_seeded."""
    demo = F.col("id").startswith("demo-")
    a = conversations.agg(F.count("*").alias("conversations"), F.count_if(~demo).alias("real_conversations"))
    b, c = notes.agg(F.count("*").alias("notes")), tags.agg(F.count("*").alias("tags"))
    one = a.crossJoin(b).crossJoin(c)  # three single rows
    return one.withColumn("is_seeded", (F.col("conversations") > 0) & (F.col("real_conversations") == 0))


def conversation_detail(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations with their messages as an ordered array."""
    fields = [c for c in messages.columns if c not in ("conversation_id", "sort_order")]
    nested = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", *fields))).alias("messages"))
    return conversations.join(nested, "id", "left")


def backfill(notes: DataFrame, conversations: DataFrame, agents: dict[str, str] = AGENTS, synthetic: str = SYNTHETIC) -> tuple[DataFrame, DataFrame]:
    """(notes, aliases) with what can be derived for notes of imported conversations that lack metadata.

    conversations: id, source, derived_project_key. A note that lacks its key, scope, source type or agent gets the derived
    project key and defaults for what is missing; a key that changes becomes an alias (alias_key, canonical_key).
    """
    about = conversations.where(F.col("source") != synthetic).select(
        F.col("id").alias("conversation_id"), F.col("source").alias("_source"), F.col("derived_project_key").alias("_key")
    )
    agent = F.coalesce(F.create_map(*(F.lit(x) for kv in agents.items() for x in kv))[F.col("_source")], F.lit("unknown"))
    lacking = F.col("project_key").isNull() | F.col("source_type").isNull() | F.col("source_agent").isNull() | (F.col("source_agent") == "unknown") | F.col("scope").isNull()
    of = notes.join(about, "conversation_id", "left").withColumn("_hit", F.col("_source").isNotNull() & lacking)
    unknown_agent = F.col("source_agent").isNull() | (F.col("source_agent") == "unknown")
    new = {
        "project_key": F.when(F.col("_hit"), F.col("_key")).otherwise(F.col("project_key")),
        "scope": F.when(F.col("_hit"), F.coalesce("scope", F.lit("project"))).otherwise(F.col("scope")),
        "source_type": F.when(F.col("_hit"), F.coalesce("source_type", F.lit("imported-conversation"))).otherwise(F.col("source_type")),
        "source_agent": F.when(F.col("_hit") & unknown_agent, agent).otherwise(F.col("source_agent")),
    }
    aliases = of.where(F.col("_hit") & (F.col("project_key") != F.col("_key"))).select(F.col("project_key").alias("alias_key"), F.col("_key").alias("canonical_key")).distinct()
    return of.select(*(new[c].alias(c) if c in new else F.col(c) for c in notes.columns)), aliases


def display_title(note_title: Column, hit_title: Column) -> Column:
    return first_non_blank(note_title, hit_title)
