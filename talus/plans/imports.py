"""Queries over session files: the test conversations written in each tool's own form, read back, imported, summarised."""

from __future__ import annotations

import json
import sqlite3
from contextlib import closing
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from talus import models
from talus.operators import gate, memory, notes, summarise, vectors
from talus.plans.views import messages, table, tool_messages
from talus.schemas import CONVERSATION, ensure_columns
from talus.shared import make_folder, put
from talus.shared import new_path as shared
from talus.sources import registry, tool_a, tool_b, tool_c, tool_d, tool_e
from talus.store import Store
from talus.streaming.ingest import import_changes


def _put(path: str, content: bytes) -> None:
    with put(path) as out:
        out.write(content)


def _database(table_name: str, rows: list[tuple[str, str]]) -> bytes:
    with closing(sqlite3.connect(":memory:")) as db:
        db.execute(f"create table {table_name} (key text unique, value blob)")
        db.executemany(f"insert into {table_name} values (?, ?)", rows)
        db.commit()
        return db.serialize()


def _stamp(turn: int) -> str:
    return f"2026-01-01T00:{turn // 60:02}:{turn % 60:02}.000Z"


def _line(row: dict) -> bytes:
    return json.dumps(row).encode() + b"\n"


def _said(row) -> str:
    return "assistant" if row.role == "assistant" else "user"


# Writers: (folder, name of the task, its conversations with their turns in order). They keep a turn, or one file of a
# key-value tool, of which a new one is begun after ROLL turns.
ROLL = 5_000


def _write_a(root: str, task: int, sessions) -> None:
    for c, rows in sessions:
        with put(f"{root}/c--Users-Projects-Shop{c % 3}/a{c}.jsonl") as out:
            out.write(_line({"type": "noise"}))
            for r in rows:
                content = r.text + "<system-reminder>x</system-reminder>" if _said(r) == "user" else [{"type": "text", "text": r.text}, {"type": "tool_use", "id": "t"}]
                out.write(_line({
                    "uuid": f"a{c}-{r.turn}", "type": _said(r), "timestamp": _stamp(r.turn), "cwd": f"/home/p{c % 3}", "gitBranch": "main", "slug": f"s{c}",
                    "message": {"role": _said(r), "content": content}}))


def _write_b(root: str, task: int, sessions) -> None:
    with put(f"{root}/index/{task}.jsonl") as index:
        for c, rows in sessions:
            index.write(b"".join(_line({"id": f"b{c}", "thread_name": n}) for n in (f"old{c}", f"thread{c}")))
            with put(f"{root}/logs/2026/rollout-2026-01-01T00-00-00-b{c}.jsonl") as out:
                event = lambda turn, kind, **payload: out.write(_line({"timestamp": _stamp(turn), "type": kind, "payload": payload}))  # noqa: B023, E731
                event(0, "session_meta", id=f"b{c}", cwd=f"/home/p{c % 3}", git={"branch": "dev"})
                for r in rows:
                    if _said(r) == "user":
                        event(r.turn, "event_msg", type="user_message", message=f"note\n{tool_b.MARKER}{r.text}")
                        continue
                    event(r.turn, "event_msg", type="agent_message", message=r.text)
                    event(r.turn, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": r.text}])
                    if r.turn % 2:
                        event(r.turn, "response_item", type="function_call")


def _workspace(folder: str, rows: list[tuple[str, str]]) -> None:
    _put(f"{folder}/workspace.json", json.dumps({"folder": "file:///home/my%20shop+1"}).encode())
    _put(f"{folder}/state.vscdb", _database("ItemTable", rows))


def _write_c(root: str, task: int, sessions) -> None:
    """Every tenth conversation is in no workspace."""
    heads, bubbles, files = [], [], 0

    def out():
        nonlocal files
        _workspace(f"{root}/workspaces/w{task}-{files}", [("composer.composerData", json.dumps({"allComposers": heads}))])
        _put(f"{root}/global/{task}-{files}.vscdb", _database("cursorDiskKV", bubbles))
        heads.clear(), bubbles.clear()
        files += 1

    for c, rows in sessions:
        if c % 10 != 7:
            heads.append({"composerId": f"c{c}", "createdAt": 1})
        for r in rows:
            bubbles.append((f"bubbleId:c{c}:{r.turn:06}", json.dumps({"type": 1 if _said(r) == "user" else 2, "text": r.text, "createdAt": _stamp(r.turn), "isAgentic": r.turn % 3 == 0})))
            if len(bubbles) >= ROLL:
                out()
    if heads or bubbles:
        out()


def _write_d(root: str, task: int, sessions) -> None:
    """Replies of every fourth turn are plans: a proposal, a step and what it came to."""
    stored, held, files = [], 0, 0
    for c, rows in sessions:
        said = []
        for r in rows:
            about = {"role": _said(r), "content": r.text, "turnIndex": r.turn, "timestamp": 5000 - r.turn, "agentMessageId": f"d{c}-{r.turn}"}
            if _said(r) == "assistant" and r.turn % 4 == 1:
                steps = [{"toolName": "edit", "thought": "no", "reasoningContent": "why"}, {"toolName": "finish", "thought": "so be it"}]
                about |= {"content": "", "agentTaskContent": {"proposal": r.text, "guideline": {"thought": "unused", "planItems": steps}}}
            said.append(about)
        stored.append({"sessionId": f"d{c}", "createdAt": 1000, "messages": said})
        held += len(said)
        if held >= ROLL:
            _workspace(f"{root}/w{task}-{files}", [(tool_d.KEY, json.dumps({"list": stored}))])
            stored, held, files = [], 0, files + 1
    if stored:
        _workspace(f"{root}/w{task}-{files}", [(tool_d.KEY, json.dumps({"list": stored}))])


def _write_e(root: str, task: int, sessions) -> None:
    """Odd conversations are JSON lines whose first line is the session."""
    _put(f"{root}/w{task}/workspace.json", json.dumps({"folder": "file:///home/my%20shop+1"}).encode())
    for c, rows in sessions:
        with put(f"{root}/w{task}/chatSessions/e{c}.json{'l' * (c % 2)}") as out:
            out.write(b'{"kind": 0, "v": ' * (c % 2) + json.dumps({"sessionId": f"e{c}", "customTitle": f"t{c}"}).encode()[:-1] + b', "requests": [')
            for n, r in enumerate(rows):
                ask = {"requestId": f"r{r.turn}", "timestamp": 1_700_000_000_000 + 10 * r.turn, "message": {"text": r.text if _said(r) == "user" else ""}, "response": [{"value": r.text}] * (_said(r) == "assistant")}
                out.write(b"," * (n > 0) + json.dumps(ask).encode())
            out.write(b"]}" + b'}\n{"kind": 1, "v": {}}\n' * (c % 2))


WRITERS = {tool_a.SOURCE: _write_a, tool_b.SOURCE: _write_b, tool_c.SOURCE: _write_c, tool_d.SOURCE: _write_d, tool_e.SOURCE: _write_e}


def _places(spark, sf_dir, *sources: str) -> dict[str, dict[str, str]]:
    """Write all conversations as session files of these tools, and say where they are.

    Only the readers are under test. Files are written by the tasks that hold the conversations, dealt by conversation
    and sorted by turn: tools A, B and E have a file a session, C and D many sessions in one.
    """
    root = shared(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = {}
    for source in sources:
        write, folder = WRITERS[source], f"{root}/{source}"
        parts = {tool_b.SOURCE: ("logs", "index"), tool_c.SOURCE: ("workspaces", "global")}.get(source, ())
        for part in parts or ("",):
            make_folder(spark, f"{folder}/{part}")

        def run(batches, write=write, folder=folder):
            rows = (r for batch in batches for r in batch.itertuples(index=False))
            write(folder, TaskContext.get().partitionId(), groupby(rows, key=lambda r: r.conv_id))
            yield pd.DataFrame({"done": [1]})

        turns.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, "done int").agg(F.sum("done")).collect()
        places[source] = {
            tool_b.SOURCE: {"root": f"{folder}/logs", "index_file": f"{folder}/index"}, tool_c.SOURCE: {"workspaces": f"{folder}/workspaces", "global_file": f"{folder}/global"},
            tool_d.SOURCE: {"workspaces": folder}, tool_e.SOURCE: {"workspaces": folder},
        }.get(source, {"root": folder})
    return places


def _parsed(spark, sf_dir, source):
    places = _places(spark, sf_dir, source)
    return registry.parse_all(spark, registry.scan_all(spark, places), places)


def source_counts(spark, sf_dir):
    """How many sessions the readers find of each tool."""
    return registry.descriptors(registry.scan_all(spark, _places(spark, sf_dir, *WRITERS)))


def _messages_of(source):
    def query(spark, sf_dir):
        return _parsed(spark, sf_dir, source)[1].select("conversation_id", "sort_order", "id", "type", F.md5("content").alias("digest"), "has_tool_use", "has_code", "timestamp")

    return query


def _conversations_of(source):
    def query(spark, sf_dir):
        return _parsed(spark, sf_dir, source)[0].select("id", "source", "project_name", "cwd", "git_branch", "slug", "message_count", "first_message_at", "last_message_at")

    return query


def import_twice(spark, sf_dir):
    """Outcomes of an import, of the same again, and of a third after a session of tool A has grown; then what is stored."""
    places = _places(spark, sf_dir, tool_a.SOURCE, tool_d.SOURCE)
    store = Store(spark, shared(spark), parts=4)
    rounds = [import_changes(spark, store, places), import_changes(spark, store, places)]
    _put(f"{places[tool_a.SOURCE]['root']}/c--Users-Projects-Shop0/a0.jsonl", b"".join(
        _line({"uuid": f"n{k}", "type": "user", "timestamp": _stamp(k), "message": {"role": "user", "content": "z" * 200}}) for k in range(3)))
    rounds.append(import_changes(spark, store, places))
    counts = [("conversations", store.read("conversations").count()), ("messages", store.read("messages").count()), ("log", store.read("import_log").count())]
    rows = [(f"{k}-{name}", n) for k, r in enumerate(rounds) for name, n in r.items()] + counts
    return spark.createDataFrame(rows, "name string, n long")


# The gate with its own lexicon, messages that only call tools, and summaries


def gate_tool_only(spark, sf_dir):
    """The shipped lexicon's signals where some messages only call a tool: those count for nothing."""
    return gate.signals(tool_messages(spark, sf_dir))


def gate_failures(spark, sf_dir):
    """Samples that the gate decides otherwise than expected."""
    rows = messages(spark, sf_dir).groupBy(F.col("conversation_id").cast("string").alias("id")).agg(F.count("*").alias("n"))
    decided = rows.select("id", F.when(F.col("n") > 5, "accept").otherwise("reject").alias("decision"), F.when(F.col("n") > 3, "accept").otherwise("reject").alias("expected"))
    return gate.failures(decided)


def _kept(spark):
    def written(df):
        path = shared(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return written


def _summarised(spark, sf_dir):
    """All conversations through the gate and a made-up judge and summariser."""
    said = messages(spark, sf_dir).withColumn("conversation_id", F.col("conversation_id").cast("string"))
    about = ensure_columns(said.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("message_count")).withColumns({"status": F.lit("imported"), "project_name": F.lit("p")}), CONVERSATION)
    marked = said.withColumn("content", F.concat("content", F.lit(" need fix because error: choose, verified and fixed; reusable pattern for next time")))
    none = spark.createDataFrame([], "id long, conversation_id string")
    return summarise.summarise_all(about, marked, none, _judge, _summary, _kept(spark))


def _judge(text: str) -> dict[str, float]:
    return dict.fromkeys(gate.DIMENSIONS, 5.0 if len(text) % 2 else 18.0)


def _summary(text: str) -> dict:
    if len(text) % 10 == 4:
        raise RuntimeError("the model failed")
    return {"title": f"T{len(text)}", "summary": text[:20], "tags": [" A", "a", f"n{len(text) % 3}"]}


def summarised_status(spark, sf_dir):
    """Conversations by what became of them, rows counted: accepted, filtered, failed."""
    conversations, made, tags = _summarised(spark, sf_dir)
    return conversations.agg(F.count("*").alias("conversations"), F.count_if(F.col("status") == "imported").alias("waiting")).crossJoin(  # single rows
        made.agg((F.count("*") == F.max("id")).alias("ids_without_gaps"), (F.count("*") == F.countDistinct("conversation_id")).alias("one_note_each"))).crossJoin(
        tags.agg((F.count("*") == F.countDistinct("note_id", "tag")).alias("tags_once")))


# Writeback


def _memories(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lists = {a: F.array().cast("array<string>") for a in memory.ARRAYS}
    lists["error_signatures"], lists["pitfalls"] = F.array(F.left("text", F.lit(1))), F.array("lang")
    return d.select(
        F.col("doc_id"), F.col("source").alias("project_key"), F.lit("project").alias("scope"), F.lit("agent-writeback").alias("source_type"), F.left("text", F.lit(10)).alias("title"),
        F.left("text", F.lit(60)).alias("summary"), F.lit("fix").alias("outcome_type"), F.col("lang").alias("root_cause"), F.lit("done").alias("resolution"), F.array("lang").alias("tags"),
        *(c.alias(a) for a, c in lists.items()),
    )


def _written_back(spark, sf_dir):
    rows = _memories(spark, sf_dir)
    stored = rows.where("doc_id % 3 = 0").select(F.col("doc_id").alias("note_id"), *rows.columns[1:])
    run = F.concat(F.lit("run"), F.floor(F.col("doc_id") / 2))
    requests = rows.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("candidate_id"), F.lit("auto").alias("mode"), F.lit("codex").alias("source_agent"), run.alias("source_run_key"), *rows.columns[1:])
    receipts = spark.createDataFrame([("codex", "run2", "created", 77, None, "created-new-memory", "pending")], "source_agent string, source_run_key string, decision string, note_id long, merged_into_note_id long, reason string, index_status string")
    return memory.write_memories(requests, stored, receipts)


def writeback_batch(spark, sf_dir):
    """The answer to each request: replayed, created, merged or skipped. New ids are numbered by key: ``into_candidate`` says whose memory was merged into."""
    answers, _, _ = _written_back(spark, sf_dir)
    made = (F.col("decision") == "created") & (F.col("note_id") != 77)
    new = answers.where(made).groupBy(F.col("note_id").alias("_new")).agg(F.min("candidate_id").alias("into_candidate"))
    rows = answers.join(new, answers["merged_into_note_id"] == new["_new"], "left")
    return rows.select(
        "candidate_id", "decision", F.when(~made, F.col("note_id")).alias("note_id"), F.when(F.col("_new").isNull(), F.col("merged_into_note_id")).alias("merged_into_note_id"), "into_candidate",
        "reason", made.alias("is_new"))


def writeback_memories(spark, sf_dir):
    """How many evidence updates each stored memory got, and its united lists."""
    _, stored, _ = _written_back(spark, sf_dir)
    updates = F.size(F.split("summary", "Evidence update:")) - 1
    return stored.join(_memories(spark, sf_dir).select(F.col("doc_id").alias("note_id")), "note_id", "left_semi").select(
        "note_id", updates.cast("long").alias("updates"), F.array_join("pitfalls", ",").alias("pitfalls")).where("updates > 0")


def writeback_receipts(spark, sf_dir):
    """Receipts by decision and state once all created memories are embedded."""
    answers, _, receipts = _written_back(spark, sf_dir)
    done = memory.completed_receipts(receipts, answers.where("decision = 'created'").select("note_id"))
    return done.groupBy("decision", "index_status").agg(F.count("*").alias("receipts"))


def memory_edges(spark, sf_dir):
    """Edges from made memories to those near them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"))
    answers = d.select("candidate_id", F.lit("created").alias("decision"), (F.col("candidate_id") + 1_000_000_000).alias("note_id"))
    near = d.select("candidate_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    near = near.select("candidate_id", (F.col("candidate_id") + F.col("k")).alias("note_id"), (F.lit(1.0) - F.col("k") * (F.col("candidate_id") % 5) / 20.0).alias("score"))
    return memory.edges_of_created(answers, near)


# Notes: filters, details, states of embedding


def notes_waiting(spark, sf_dir):
    """Notes that still need vectors and whose task isn't running."""
    d = table(spark, sf_dir, "documents")
    state = F.element_at(F.array(*(F.lit(x) for x in ("done", "pending", "failed", "syncing"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return notes.embedding_backlog(d.select(F.col("doc_id").alias("id"), state.alias("embedding_status")), d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))


def conversations_waiting(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    state = F.element_at(F.array(*(F.lit(x) for x in ("imported", "summarized", "error", "filtered", "summarizing"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return notes.unsummarised(d.select(F.col("doc_id").alias("id"), state.alias("status")))


def conversation_details(spark, sf_dir):
    """Each conversation with its messages in order, as one digest."""
    said = messages(spark, sf_dir)
    about = said.select(F.col("conversation_id").alias("id")).distinct()
    out = notes.conversation_detail(about, said.select("conversation_id", "sort_order", "type", "content"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["type"], F.lit(":"), m["content"])), "\n")
    return out.select("id", F.size("messages").cast("long").alias("messages"), F.md5(text).alias("digest"))


def tags_literal(spark, sf_dir):
    """Tags with a percent sign or an underscore: nothing in the search is a wildcard."""
    tags = table(spark, sf_dir, "documents").select(F.concat("source", F.when(F.col("doc_id") % 2 == 0, "_%x").otherwise("y")).alias("tag")).distinct()
    return notes.tags_containing(tags, "_%X")


def embedding_states(spark, sf_dir):
    """Notes after a swap: chunks of failed notes stay, those of done ones are new, syncing notes with their own chunks are done."""
    e = table(spark, sf_dir, "embeddings")
    id_ = F.floor(F.col("vec_id") / 2).cast("long")
    chunks = vectors.with_norm(e.select(id_.alias("note_id"), (F.col("vec_id") % 2).cast("int").alias("chunk_index"), F.lit("old").alias("chunk_text"), F.col("embedding").alias("vector")))
    rows = chunks.select("note_id").distinct().select(F.col("note_id").alias("id"), F.lit("pending").alias("embedding_status"))
    texts = chunks.where("note_id % 3 <> 0").select("note_id", "chunk_index", F.concat(F.lit("new"), F.when(F.col("note_id") % 5 == 0, "!").otherwise("")).alias("chunk_text"))
    fresh = vectors.embed(texts, _picky, failing=True)
    rows = vectors.syncing(rows, chunks.where("note_id % 3 = 0").select("note_id"))
    after, stored = vectors.swapped_chunks(rows, chunks, fresh)
    after = vectors.finalised(after, stored, chunks.where("note_id % 6 = 0").select("note_id", "chunk_index", "chunk_text"))
    kinds = stored.groupBy(F.col("note_id").alias("id")).agg(F.min("chunk_text").alias("chunk_text"))
    return after.join(kinds, "id").select("id", "embedding_status", "chunk_text")


def _picky(texts: list[str]) -> list[list[float]]:
    if any("!" in t for t in texts):
        raise RuntimeError("not this one")
    return models.hashing_embedder(8)(texts)


def search_with_tags(spark, sf_dir):
    """Hits with the tags of their notes."""
    hits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), F.col("label").alias("score"))
    tags = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("note_id"), F.explode(F.array("lang", "source")).alias("tag"))
    return vectors.with_note_tags(hits, tags).select("note_id", F.array_join("tags", ",").alias("tags"))


_SAID = f"""
with m as (
  select conv_id as c, turn, case when role = 'assistant' then 'assistant' else 'user' end as type, text,
         '2026-01-01T00:' || lpad(cast(turn // 60 as varchar), 2, '0') || ':' || lpad(cast(turn % 60 as varchar), 2, '0') || '.000Z' as stamp,
         row_number() over (partition by conv_id order by turn) - 1 as n
  from conversations
), kept as (
  select *, row_number() over (partition by c order by n) - 1 as sort_order from m where text <> ''
)"""


def _sql_messages(prefix: str, id_: str, tool: str = "false", at: str = "stamp", text: str = "text") -> str:
    return _SAID + f"""
select '{prefix}' || c as conversation_id, cast(sort_order as bigint) as sort_order, {id_} as id, type, md5({text}) as digest, {tool} as has_tool_use,
       contains({text}, '```') as has_code, {at} as timestamp from kept"""


def _sql_conversations(prefix: str, columns: str, at: str = "stamp") -> str:
    return _SAID + f"""
select '{prefix}' || c as id, {columns}, count(*) as message_count, arg_min({at}, sort_order) as first_message_at, arg_max({at}, sort_order) as last_message_at
from kept group by c"""


_D_AT = "strftime(make_timestamp((sort_order + greatest(1000, max(5000 - turn - sort_order) over (partition by c order by sort_order rows unbounded preceding))) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_PLAN = "(type = 'assistant' and turn % 4 = 1)"
_E_AT = "strftime(make_timestamp((1700000000000 + 10 * turn + case when type = 'assistant' then 1 else 0 end) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_SPACES = "' ' || chr(9) || chr(10) || chr(13)"
_LEXICON = gate.Lexicon()

_ALL_IMPORTED = f"(select count(*) from (select conv_id from conversations group by conv_id having count(*) >= 2))"
_ALL = f"(select count(distinct conv_id) from conversations)"
_WRITTEN = """
with d as (select doc_id, source, lang, left(text, 60) as summary, left(text, 1) as sign from documents),
r as (select *, 'run' || (doc_id // 2) as run from d where doc_id % 3 <> 0),
f as (select *, row_number() over (partition by run order by doc_id) as nth from r where run <> 'run2'),
t as (select source, lang, sign, min(doc_id) as target from d where doc_id % 3 = 0 group by all),
s as (
  select f.*, t.target, length(regexp_replace(summary, '\\s', '', 'g')) < 24 or length(trim(summary, ' ' || chr(9) || chr(10) || chr(13))) < 24 as short
  from f left join t using (source, lang, sign) where nth = 1
), a as (
  select run, doc_id, case when short then 'skipped' when target is null and doc_id = first then 'created' else 'merged' end as decision, case when not short then target end as target,
         case when not short and target is null and doc_id <> first then first end as into_candidate
  from (select *, min(doc_id) over (partition by source, lang, sign, short, target is null) as first from s)
)"""

ORACLE = {
    "source_counts": f"select unnest(['claude-code', 'codex', 'cursor', 'trae', 'copilot']) as source, {_ALL} as conversations",
    "tool_a_messages": _sql_messages("a", "'a' || c || '-' || turn", "type = 'assistant'"),
    "tool_a_conversations": _sql_conversations("a", "'claude-code' as source, 'Shop' || (c % 3) as project_name, '/home/p' || (c % 3) as cwd, 'main' as git_branch, 's' || c as slug"),
    "tool_b_messages": _sql_messages("b", "'b' || c || ':' || (1 + n + coalesce((select sum(case when o.type = 'assistant' then 1 + o.turn % 2 else 0 end) from m o where o.c = kept.c and o.n < kept.n), 0))", "type = 'assistant' and turn % 2 = 1"),
    "tool_b_conversations": _sql_conversations("b", "'codex' as source, 'p' || (c % 3) as project_name, '/home/p' || (c % 3) as cwd, 'dev' as git_branch, 'thread' || c as slug"),
    "tool_c_messages": _sql_messages("c", "lpad(cast(turn as varchar), 6, '0')", "turn % 3 = 0"),
    "tool_c_conversations": _sql_conversations("c", "'cursor' as source, case when c % 10 = 7 then '' else 'my shop+1' end as project_name, case when c % 10 <> 7 then 'home/my shop+1' end as cwd, null as git_branch, null as slug"),
    "tool_d_messages": _sql_messages("d", "'d' || c || '-' || turn", _PLAN, _D_AT, f"text || case when {_PLAN} then chr(10) || chr(10) || 'so be it' else '' end"),
    "tool_d_conversations": _SAID + f""", t as (select *, {_D_AT} as ts from kept)
select 'd' || c as id, 'trae' as source, 'my shop+1' as project_name, 'home/my shop+1' as cwd, null as git_branch, null as slug, count(*) as message_count,
       arg_min(ts, sort_order) as first_message_at, arg_max(ts, sort_order) as last_message_at from t group by c""",
    "tool_e_messages": _sql_messages("e", "case when type = 'assistant' then 'resp-' else '' end || 'r' || turn", at=_E_AT),
    "tool_e_conversations": _sql_conversations("e", "'copilot' as source, 'my shop+1' as project_name, 'home/my shop+1' as cwd, null as git_branch, 't' || c as slug", at=_E_AT),
    "import_twice": f"""
with n as (select {_ALL} as every, {_ALL_IMPORTED} as long, (select count(*) from conversations where conv_id in
    (select conv_id from conversations group by conv_id having count(*) >= 2)) as said, (select count(*) from conversations where conv_id = 0) as zero)
select unnest(['0-imported', '0-skipped', '0-unchanged', '1-imported', '1-skipped', '1-unchanged', '2-imported', '2-skipped', '2-unchanged', 'conversations', 'messages', 'log']) as name,
       unnest([2 * long, 2 * every - 2 * long, 0, 0, 0, 2 * every, 1, 0, 2 * every - 1, 2 * long, 2 * said - zero + 3, 2 * every]) as n from n""",
    "gate_tool_only": f"""
with m as (
  select conv_id as conversation_id, turn as sort_order, role as type, case when turn % 4 = 3 then '' else text end as content,
         turn % 4 = 3 or (role = 'assistant' and length(text) % 7 = 0) as tool, length(text) % 5 = 0 as code from conversations
), k as (select * from m where not (tool and content = '')), g as (
  select conversation_id, string_agg(content, chr(10) order by sort_order) as text, count(*) filter (type = 'user' and not regexp_matches(trim(content, {_SPACES}), '{_LEXICON.low_info}')) as effective_turns,
         bool_or(tool or code) as marked from k group by conversation_id
), s as (
  select conversation_id, effective_turns, length(regexp_replace(text, '\\s', '', 'g')) as content_chars,
         {", ".join(f"{'marked or ' if n == 'code' else ''}regexp_matches(text, '{getattr(_LEXICON, n)}') as has_{n}_signal" for n in ("problem", "error", "code", "process", "decision", "outcome", "reuse"))}
  from g
)
select *, effective_turns = 1 and content_chars >= 120 and has_problem_signal and has_decision_signal and (has_outcome_signal or has_reuse_signal) as has_strong_single_turn_signal from s""",
    "gate_failures": """
with n as (select cast(conv_id as varchar) as id, count(*) as n from conversations group by conv_id),
d as (select id, case when n > 5 then 'accept' else 'reject' end as decision, case when n > 3 then 'accept' else 'reject' end as expected from n)
select * from d where decision <> expected""",
    "summarised_status": "select count(distinct conv_id) as conversations, 0 as waiting, true as ids_without_gaps, true as one_note_each, true as tags_once from conversations",
    "writeback_batch": _WRITTEN + """
select r.doc_id as candidate_id, case when r.run = 'run2' then 'created' else a.decision end as decision, case when r.run = 'run2' then 77 end as note_id,
       a.target as merged_into_note_id, a.into_candidate, case when r.run = 'run2' or a.decision = 'created' then 'created-new-memory' when a.decision = 'merged' then 'merged-into-existing-memory' else 'low-signal' end as reason,
       r.run <> 'run2' and a.decision = 'created' as is_new
from r left join a using (run)""",
    "writeback_memories": _WRITTEN + """
select target as note_id, count(*) as updates, any_value((select lang from documents o where o.doc_id = target)) as pitfalls from a where target is not null group by target""",
    "writeback_receipts": _WRITTEN + """
select decision, case when target is not null then 'pending' else 'completed' end as index_status, count(*) as receipts
from (select decision, target from a union all select 'created', null) group by all""",
    "memory_edges": """
with n as (select doc_id, k, doc_id + k as note_id, 1.0 - k * (doc_id % 5) / 20.0 as score from documents, range(1, 7) t(k)),
r as (select *, row_number() over (partition by doc_id order by score desc, note_id) as nth from n where score >= 0.75)
select doc_id + 1000000000 as source_note_id, note_id as target_note_id, 'SIMILAR_TO' as relation_type, cast(0.75 as double) as confidence from r where nth <= 3""",
    "notes_waiting": "select doc_id as id, case doc_id % 4 when 1 then 'pending' when 2 then 'failed' else 'syncing' end as embedding_status from documents where doc_id % 4 <> 0 and doc_id % 3 <> 0",
    "conversations_waiting": "select doc_id as id, case doc_id % 5 when 0 then 'imported' when 2 then 'error' else 'summarizing' end as status from documents where doc_id % 5 in (0, 2, 4)",
    "conversation_details": "select conv_id as id, count(*) as messages, md5(string_agg(role || ':' || text, chr(10) order by turn)) as digest from conversations group by conv_id",
    "tags_literal": "select distinct source || '_%x' as tag from documents where doc_id % 2 = 0",
    "embedding_states": """
with n as (select distinct vec_id // 2 as id from embeddings)
select id, case when id % 3 <> 0 then case when id % 5 = 0 then 'failed' else 'done' end when id % 6 = 0 then 'done' else 'syncing' end as embedding_status,
       case when id % 3 <> 0 and id % 5 <> 0 then 'new' else 'old' end as chunk_text from n""",
    "search_with_tags": """
select vec_id as note_id, case when lang is null then '' when lang < source then lang || ',' || source else source || ',' || lang end as tags
from (select vec_id from embeddings) left join (select * from documents where doc_id % 2 = 0) on vec_id = doc_id""",
}

QUERIES = {
    f.__name__: f
    for f in (
        source_counts, import_twice, gate_tool_only, gate_failures, summarised_status, writeback_batch, writeback_memories, writeback_receipts, memory_edges, notes_waiting,
        conversations_waiting, conversation_details, tags_literal, embedding_states, search_with_tags,
    )
}
for _name, _tool in (("a", tool_a), ("b", tool_b), ("c", tool_c), ("d", tool_d), ("e", tool_e)):
    QUERIES[f"tool_{_name}_messages"] = _messages_of(_tool.SOURCE)
    QUERIES[f"tool_{_name}_conversations"] = _conversations_of(_tool.SOURCE)
