"""The chain from conversation to related note: one run, runs that die after each stage, claims, and summaries anew."""

import hashlib
import os
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F

from talus import models
from talus.operators import gate
from talus.operators.chain import Chain
from talus.schemas import CONVERSATION, MESSAGE, ensure_columns
from talus.store import Change, Store

GOOD = "We need this because it failed with an error. Verified and fixed; a reusable pattern for next time. "
TABLES = ("conversations", "notes", "note_tags", "chunks", "relations", "claims", "staged_decisions", "staged_summaries", "staged_vectors")


class Died(Exception):
    pass


def filled(spark, path):
    rows = [(i, "p", "imported", f"/home/{i[0]}") for i in ("good1", "good2", "bad", "low", "broken", "tools", "empty")] + [("old", "p", "summarized", "/x")]
    store = Store(spark, f"file://{path}", parts=2)
    conversations = ensure_columns(spark.createDataFrame(rows, "id string, project_name string, status string, cwd string"), CONVERSATION).select(*CONVERSATION.names)
    said = [(c, str(k), k, "user" if k % 2 == 0 else "assistant", "" if c == "tools" else "hi" if c == "bad" else f"{GOOD} {c}", c == "tools") for c, *_ in rows if c != "empty" for k in range(4)]
    messages = ensure_columns(spark.createDataFrame(said, "conversation_id string, id string, sort_order long, type string, content string, has_tool_use boolean"), MESSAGE).select(*MESSAGE.names)
    store.commit({}, {"conversations": Change(conversations, conversations.select("id"), "id"), "messages": Change(messages, messages.select("conversation_id"), "conversation_id")})
    return store


def asked(folder, kind, text):
    """Leave a mark for each time a model is asked; workers share the folder in local mode."""
    name = f"{folder}/{kind}-{hashlib.sha256(text.encode()).hexdigest()}"
    with open(name, "a") as out:
        out.write("x")


def chain(store, folder, title="T", **options):
    folder = str(folder)
    os.makedirs(folder, exist_ok=True)
    embed = models.hashing_embedder(8)

    def judge(text):
        asked(folder, "judge", text)
        return dict.fromkeys(gate.DIMENSIONS, 2 if " low" in text else 19)

    def summarise(text):
        asked(folder, "summary", text)
        if " broken" in text:
            raise RuntimeError("429")
        return {"title": title, "summary": text[-6:], "tags": ["A ", "a", "b"]}

    def model(texts):
        for t in texts:
            asked(folder, "vector", t)
        return embed(texts)

    def propose(candidates):
        return candidates.select("source_note_id", "target_note_id", F.lit("SIMILAR_TO").alias("relation_type"), F.lit(0.8).alias("confidence"), F.lit(1).alias("position"))

    return Chain(store, judge, summarise, model, propose, **options)


def content(store):
    """All that a run leaves, without times; new notes are told apart by their conversation."""
    notes = {r.id: r.conversation_id for r in store.read("notes").collect()}
    return {
        "conversations": sorted((r.id, r.status, r.experience_gate_reason) for r in store.read("conversations").collect()),
        "notes": sorted((r.conversation_id, r.title, r.summary, r.embedding_status, r.project_key, r.scope, r.source_type) for r in store.read("notes").collect()),
        "tags": sorted((notes[r.note_id], r.tag) for r in store.read("note_tags").collect()),
        "chunks": sorted((notes[r.note_id], r.chunk_index, r.chunk_text, tuple(r.vector)) for r in store.read("chunks").collect()),
        "relations": sorted((notes[r.source_note_id], notes[r.target_note_id], r.relation_type, r.confidence) for r in store.read("relations").collect()),
        "open": [store.read(t).count() for t in ("claims", "staged_decisions", "staged_summaries", "staged_vectors")],
    }


def test_runs_that_die_end_as_one_that_does_not_and_a_summary_anew_keeps_its_note(spark, tmp_path):
    whole = filled(spark, tmp_path / "whole")
    counts = chain(whole, tmp_path / "asked-whole").run()
    assert counts == {"summarized": 3, "filtered": 2, "error": 3}
    want = content(whole)
    assert dict((i, (s, r)) for i, s, r in want["conversations"]) == {
        "good1": ("summarized", None), "good2": ("summarized", None), "bad": ("filtered", "low-signal"), "low": ("filtered", "experience-threshold-not-met"), "broken": ("error", "429"),
        "tools": ("error", "no meaningful messages in conversation"), "empty": ("error", "no meaningful messages in conversation"), "old": ("summarized", None)}
    assert [n[:4] for n in want["notes"]] == [("good1", "T", " good1", "done"), ("good2", "T", " good2", "done")]
    assert all(n[4].startswith("cwd:") and n[5:] == ("project", "imported-conversation") for n in want["notes"])
    assert want["relations"] == [("good1", "good2", "SIMILAR_TO", 0.8), ("good2", "good1", "SIMILAR_TO", 0.8)] and want["open"] == [0, 0, 0, 0]
    store = filled(spark, tmp_path / "dying")
    for last in ("claimed", "judged", "summarised", "saved", "embedding", None):
        def dies(stage, last=last):
            if stage == last:
                raise Died

        with pytest.raises(Died) if last else nullcontext():
            chain(store, tmp_path / "asked", lease=0, after=dies).run()
        if last == "claimed":
            assert chain(store, tmp_path / "asked").run()["summarizing"] == 7  # another run leaves them while the claim holds
    assert content(store) == want
    marks = {n: os.path.getsize(tmp_path / "asked" / n) for n in os.listdir(tmp_path / "asked")}
    once = {n for n, c in marks.items() if c == 1}
    assert set(marks) == set(os.listdir(tmp_path / "asked-whole")) and len(marks) - len(once) == 2  # what failed waits for the next run, and is judged and summarised again by it
    before = {r.conversation_id: r.id for r in whole.read("notes").collect()}
    chain(whole, tmp_path / "anew", title="NEW").run(again=spark.createDataFrame([("good2",)], "id string"))
    after = {r.conversation_id: (r.id, r.title, r.embedding_status) for r in whole.read("notes").collect()}
    assert after == {"good1": (before["good1"], "T", "done"), "good2": (before["good2"], "NEW", "done")}
    texts = {r.note_id: r.chunk_text for r in whole.read("chunks").collect()}
    assert texts[before["good2"]].startswith("NEW") and texts[before["good1"]].startswith("T") and whole.read("relations").count() == 2
    assert whole.read("note_tags").where(F.col("note_id") == before["good2"]).count() == 2
