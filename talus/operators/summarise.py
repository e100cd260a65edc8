"""From imported conversations to notes: transcript, gate, judge, summary, tags, status; then vectors and relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import normalised_tags
from talus.operators import gate
from talus.operators.chunks import chunk
from talus.operators.graph import KEY, add_relations, discovered
from talus.operators.notes import embedding_text, unsummarised
from talus.operators.turns import meaningful, transcripts
from talus.operators.vectors import VectorIndex, embed, swapped_chunks, top_chunks_of_many
from talus.store import upsert, with_new_ids

#: A judge gives the five dimensions of a transcript; a summariser a dict with title, summary, conclusions and tags.
Judge = Callable[[str], dict[str, float]]
Summariser = Callable[[str], dict]
SUMMARY = "conversation_id string, title string, summary string, key_conclusions array<string>, tags array<string>, failed string"
CANDIDATES = 20


def judged(texts: DataFrame, judge: Judge) -> DataFrame:
    """(conversation_id, transcript) -> (conversation_id, DIMENSIONS), between 0 and 20."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judge(t) for t in batch["transcript"]]
            yield pd.DataFrame({"conversation_id": batch["conversation_id"], **{d: [min(20.0, max(0.0, float(r.get(d, 0)))) for r in rows] for d in gate.DIMENSIONS}})

    return texts.select("conversation_id", "transcript").mapInPandas(run, "conversation_id string, " + ", ".join(f"{d} double" for d in gate.DIMENSIONS))


def summaries(texts: DataFrame, summarise: Summariser) -> DataFrame:
    """(conversation_id, transcript) -> SUMMARY; a failure is a row with its message, and stops nothing else."""

    def one(conversation_id: str, transcript: str) -> dict:
        try:
            got = summarise(transcript)
            return {"conversation_id": conversation_id, "title": got["title"], "summary": got["summary"], "key_conclusions": list(got.get("key_conclusions", [])), "tags": list(got.get("tags", [])), "failed": None}
        except Exception as error:  # noqa: BLE001 - whatever a model raises becomes the conversation's status
            return {"conversation_id": conversation_id, "title": None, "summary": None, "key_conclusions": [], "tags": [], "failed": str(error)[:500]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(c, t) for c, t in zip(batch["conversation_id"], batch["transcript"], strict=True)], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return texts.select("conversation_id", "transcript").mapInPandas(run, SUMMARY)


#: Why a conversation in which nobody says anything ends in error.
NO_TEXT = "no meaningful messages in conversation"


def without_text(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations that have no message, or none but calls of tools."""
    return conversations.join(meaningful(messages).select(F.col("conversation_id").alias("id")), "id", "left_anti")


def summarise_all(
    conversations: DataFrame, messages: DataFrame, notes: DataFrame, judge: Judge, summarise: Summariser, written: Callable[[DataFrame], DataFrame], budget: int = 32_000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, new notes, their tags) after all conversations that wait for it.

    Conversations that have a note are left alone, and those without a meaningful message end in error. The lexical prefilter comes before the judge, the judge before the
    summary, so a model only ever sees what is left; ``written`` cuts lineage after each model, so none is asked twice.
    notes: conversation_id and id; new ids go on from the largest.
    """
    waiting = unsummarised(conversations).join(notes.select(F.col("conversation_id").alias("id")), "id", "left_anti").select("id", "project_name", "git_branch")
    own = messages.join(waiting.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    ready = gate.prefilter(gate.signals(own)).where("prefilter_reason is null").select("conversation_id")
    texts = written(transcripts(own.join(ready, "conversation_id", "left_semi"), waiting, budget))
    decisions = written(gate.decide(own, written(judged(texts, judge))))
    good = texts.join(decisions.where("decision = 'accept'"), "conversation_id", "left_semi")
    done = written(summaries(good, summarise))
    last = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = with_new_ids(done.where("failed is null"), "conversation_id", "id", last)
    new = made.select("id", "conversation_id", "title", "summary", "key_conclusions", F.lit("pending").alias("embedding_status"))
    tags = made.select(F.col("id").alias("note_id"), F.explode(normalised_tags(F.col("tags"))).alias("tag"))
    marked = gate.mark_filtered(conversations, decisions)
    silent = without_text(waiting, messages).select("id", F.lit("error").alias("_status"), F.lit(NO_TEXT).alias("_why")).toDF("_id", "_status", "_why")
    state = done.select(F.col("conversation_id").alias("_id"), F.when(F.col("failed").isNull(), "summarized").otherwise("error").alias("_status"), F.col("failed").alias("_why"))
    state = state.unionByName(silent)
    out = marked.join(state, marked.id == state["_id"], "left")
    changed = {"status": F.coalesce("_status", "status"), "experience_gate_reason": F.coalesce("_why", "experience_gate_reason")}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in marked.columns)), new, tags


def resummarised(notes: DataFrame, note_tags: DataFrame, new: DataFrame, new_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, note_tags) with new summaries stored: a conversation's note is replaced where it has one, under the id it had.

    new: id, conversation_id and a note's columns; new_tags: note_id, tag. Tags of replaced notes are those of the new summary.
    """
    had = notes.select("conversation_id", F.col("id").alias("_old"))
    ids = new.select(F.col("id").alias("_new"), "conversation_id").join(had, "conversation_id", "left").select("_new", F.coalesce("_old", "_new").alias("_id"))
    placed = new.join(ids, new.id == ids["_new"]).withColumn("id", F.col("_id")).select(*new.columns)
    tags = new_tags.join(ids, new_tags.note_id == ids["_new"]).select(F.col("_id").alias("note_id"), "tag")
    stay = note_tags.join(ids.select(F.col("_id").alias("note_id")), "note_id", "left_anti")
    return upsert(notes, placed, ["conversation_id"]), stay.select("note_id", "tag").unionByName(tags).distinct()


def embed_and_relate(
    notes: DataFrame, note_tags: DataFrame, chunks: DataFrame, relations: DataFrame, model: Callable[[list[str]], list[list[float]]],
    propose: Callable[[DataFrame], DataFrame], written: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, chunks, relations) once the notes that wait for vectors are embedded and related: what follows a summary.

    propose: (source_note_id, target_note_id) candidates -> a model's proposals for ``graph.discovered``. New relations
    get ids that go on from the largest. Notes whose text can't be embedded are left as failed, and stop nothing else.
    """
    waiting = notes.where(F.col("embedding_status").isin("pending", "failed", "syncing"))
    texts = embedding_text(waiting, note_tags)
    fresh = written(embed(chunk(texts), model, failing=True))
    notes, chunks = swapped_chunks(notes, chunks, fresh)
    titles = fresh.where("chunk_index = 0 and failed is null").select(F.col("note_id").alias("query_id"), "vector")
    candidates = written(relation_candidates(notes, titles, chunks))
    found = add_relations(relations.drop("id"), discovered(propose(candidates), candidates).select("source_note_id", "target_note_id", "relation_type", "confidence"))
    last = relations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = found.join(relations.select(*KEY), KEY, "left_anti").withColumn("_key", F.concat_ws(":", *KEY))
    return notes, chunks, relations.unionByName(with_new_ids(added, "_key", "id", last).drop("_key"), allowMissingColumns=True)


def reset_errors(conversations: DataFrame) -> DataFrame:
    """Conversations in error wait again."""
    return conversations.withColumn("status", F.when(F.col("status") == "error", "imported").otherwise(F.col("status")))


def relation_candidates(notes: DataFrame, title_vectors: DataFrame, chunks: DataFrame, most: int = CANDIDATES, index: VectorIndex | None = None) -> DataFrame:
    """(source_note_id, target_note_id): for each note (query_id, vector) the notes its title is most similar to.

    A note that finds none but itself takes the latest others instead. With an ``index`` of the chunks only the lists
    near a title are looked at; without, all chunks are, which is the product of titles and chunks.
    """
    found = index.search(title_vectors, most) if index is not None else top_chunks_of_many(chunks, title_vectors, most)
    near = found.where("note_id <> query_id").select(F.col("query_id").alias("source_note_id"), F.col("note_id").alias("target_note_id")).distinct()
    alone = title_vectors.select(F.col("query_id").alias("source_note_id")).join(near.select("source_note_id"), "source_note_id", "left_anti")
    latest = notes.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(most + 1).select(F.col("id").alias("target_note_id"))
    # At most ``most`` + 1 rows against the notes that found nothing.
    rest = alone.join(F.broadcast(latest), F.col("source_note_id") != F.col("target_note_id"))
    nth = F.row_number().over(Window.partitionBy("source_note_id").orderBy("target_note_id"))
    return near.unionByName(rest.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n"))


def after_model_change(notes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, chunks) once another embedding model is chosen: no vectors, and every note waits for new ones."""
    return notes.withColumn("embedding_status", F.lit("pending")), chunks.where("false")


def after_embedding(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """notes with status done where they have chunks."""
    have = chunks.select(F.col("note_id").alias("_have")).distinct()
    out = notes.join(have, notes.id == have["_have"], "left")
    return out.withColumn("embedding_status", F.when(F.col("_have").isNotNull(), "done").otherwise(F.col("embedding_status"))).drop("_have")
