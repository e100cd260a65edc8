"""The normalised model: tables, enumerations, and columns added over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()),
    "snippets": T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("language", "code", "description")])),
}


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[kind]) for n, kind in (c.split() for c in columns.split(","))])


MESSAGE = _table(
    "conversation_id string, id string, parent_uuid string, type string, role string, content string, has_tool_use boolean, "
    "has_code boolean, thinking string, timestamp string, sort_order long"
)
CONVERSATION = _table(
    "id string, slug string, source string, project_dir string, project_name string, cwd string, git_branch string, message_count long, "
    "first_message_at string, last_message_at string, file_path string, file_size long, file_mtime string, status string, experience_score double, "
    "experience_gate_reason string, experience_gate_details string, created_at timestamp, updated_at timestamp"
)
NOTE = _table(
    "id long, conversation_id string, title string, summary string, key_conclusions strings, "
    "code_snippets snippets, raw_llm_response string, is_edited boolean, embedding_status string, "
    "project_key string, scope string, source_type string, source_agent string, task_kind string, error_signatures strings, "
    "files_touched strings, outcome_type string, created_at timestamp, updated_at timestamp"
)
RELATION = _table(
    "id long, source_note_id long, target_note_id long, relation_type string, confidence double, description string, created_at timestamp"
)
CHUNK = _table("note_id long, chunk_index int, chunk_text string, vector floats")
RECEIPT = _table(
    "source_agent string, source_run_key string, decision string, note_id long, merged_into_note_id long, reason string, index_status string"
)

#: Fixed values.
STATUSES = ("imported", "summarizing", "summarized", "filtered", "error")
MESSAGE_TYPES = ("user", "assistant", "system")
OUTCOMES = ("pitfall", "fix", "pattern", "decision")
RELATIONS = ("CAUSED_BY", "LEADS_TO", "RESOLVED_BY", "SIMILAR_TO", "CONTRADICTS", "DEPENDS_ON", "EXTENDS", "REFERENCES")
LOW_SIGNAL_REASONS = ("low-signal", "filtered", "no reusable experience", "no-reusable-experience")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns in its order and types; those it lacks are null, others stay at the end."""
    have = {c.lower(): c for c in df.columns}
    known = [(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    wanted = {f.name.lower() for f in schema}
    return df.select(*known, *(c for c in df.columns if c.lower() not in wanted))


def low_signal_reason(reason: str = "experience_gate_reason"):
    return F.lower(F.trim(F.coalesce(F.col(reason), F.lit("")))).isin(*LOW_SIGNAL_REASONS)


def migrate_statuses(conversations: DataFrame) -> DataFrame:
    """Conversations in error for want of content count as filtered."""
    low = (F.col("status") == "error") & low_signal_reason()
    return conversations.withColumn("status", F.when(low, F.lit("filtered")).otherwise(F.col("status")))
