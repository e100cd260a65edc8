"""From a waiting conversation to a related note, in stages that are claimed, kept and taken up again after a run that died."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.text import normalised_tags
from talus.operators import gate
from talus.operators.chunks import chunk
from talus.operators.graph import KEY, discovered
from talus.operators.memory import project_key
from talus.operators.notes import embedding_text, unsummarised
from talus.operators.summarise import CANDIDATES, NO_TEXT, SUMMARY, Judge, Summariser, judged, relation_candidates, summaries, without_text
from talus.operators.turns import transcripts
from talus.operators.vectors import VectorIndex, embed, swapped_chunks
from talus.schemas import NOTE, RELATION, ensure_columns
from talus.shared import written
from talus.store import Change, Store, with_new_ids

STAGES = ("claimed", "judged", "summarised", "saved", "embedding", "embedded", "related")
DECISION = "conversation_id string, decision string, score double, confidence double, reason string, missing_signals array<string>"
VECTOR = "note_id long, chunk_index int, chunk_text string, vector array<float>, failed string, norm double"


@dataclass
class Chain:
    """Works all waiting conversations of a store to related notes.

    Each stage commits what a model gave before the next begins, so a run that dies is taken up where it stopped and no
    model is asked again for what it has answered. A conversation is claimed by one run at a time: the claim is a commit
    with the run's name, of two that claim the same conversation one loses and leaves it, and a claim older than
    ``lease`` seconds may be taken over. Tables: conversations, messages, notes, note_tags, chunks, relations, claims, and
    staged_decisions, staged_summaries, staged_vectors, which are empty between runs.
    ``after`` is called with each stage's name once it is committed.
    """

    store: Store
    judge: Judge
    summarise: Summariser
    model: Callable[[list[str]], list[list[float]]]
    propose: Callable[[DataFrame], DataFrame]
    budget: int = 32_000
    lease: int = 3600
    indexed: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    after: Callable[[str], None] = lambda stage: None

    def run(self, again: DataFrame | None = None) -> dict[str, int]:
        """One pass; how many conversations are in each status afterwards. again: (id) of conversations to summarise anew, whose notes keep their ids."""
        for stage, work in zip(STAGES, (lambda: self._claim(again), self._judge, self._summarise, self._save, self._embed, self._swap, self._relate), strict=True):
            work()
            self.after(stage)
        return dict(self._table("conversations").groupBy("status").count().collect())

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        df = self.store.read(name)
        return df if df is not None else self.store.spark.createDataFrame([], schema)

    def _commit(self, **changes: tuple[DataFrame, str] | tuple[DataFrame, str, DataFrame]) -> None:
        """Rows by key in place of those with the same keys, or of the keys given."""
        self.store.commit({}, {n: Change(c[0], c[2] if len(c) > 2 else c[0].select(c[1]).distinct(), c[1]) for n, c in changes.items()})

    # Claims

    def _claims(self) -> DataFrame:
        return self._table("claims", "conversation_id string, run_id string, claimed_at timestamp, renews boolean")

    def _mine(self) -> DataFrame:
        return self._claims().where(F.col("run_id") == self.run_id).select("conversation_id", "renews")

    def _claim(self, again: DataFrame | None) -> None:
        def take(t):
            conversations = t.read("conversations")
            claims = t.read("claims")
            claims = claims if claims is not None else self._claims()
            had = self._table("notes", NOTE.simpleString()).select(F.col("conversation_id").alias("id")).distinct()
            wanted = unsummarised(conversations).select("id").join(had, "id", "left_anti").withColumn("renews", F.lit(False))
            if again is not None:
                renewed = conversations.select("id").join(again.select("id"), "id", "left_semi").withColumn("renews", F.lit(True))
                wanted = wanted.join(renewed.select("id"), "id", "left_anti").unionByName(renewed)
            live = (F.col("run_id") != self.run_id) & (F.col("claimed_at") > F.expr(f"current_timestamp() - interval {self.lease} seconds"))
            old = claims.select(F.col("conversation_id").alias("id"), live.alias("_live"), F.col("renews").alias("_renews"))
            taken = old.select("id", "_live", "_renews")
            free = wanted.join(taken, "id", "left").where("_live is null or not _live")
            left = taken.where("not _live").join(wanted.select("id"), "id", "left_anti").select("id", F.col("_renews").alias("renews"))  # of a run that died while renewing
            ours = free.select("id", (F.col("renews") | F.coalesce("_renews", F.lit(False))).alias("renews")).unionByName(left)
            ours = written(ours.select(F.col("id").alias("conversation_id"), F.lit(self.run_id).alias("run_id"), F.current_timestamp().alias("claimed_at"), "renews"), "claims")
            if ours.isEmpty():
                return
            t.change("claims", Change(ours, ours.select("conversation_id"), "conversation_id"))
            begun = conversations.join(ours.select(F.col("conversation_id").alias("id")), "id", "left_semi").select(*conversations.columns)
            t.change("conversations", Change(begun.withColumn("status", F.lit("summarizing")), begun.select("id"), "id"))

        self.store.run(take)

    # Models

    def _texts(self, ids: DataFrame) -> DataFrame:
        own = self._table("messages").join(ids.select("conversation_id"), "conversation_id", "left_semi")
        about = self._table("conversations").join(ids.select(F.col("conversation_id").alias("id")), "id", "left_semi")
        return transcripts(own, about, self.budget)

    def _judge(self) -> None:
        """Decisions of claimed conversations that have none yet; one without text is an error, and the judge sees only what passes the prefilter."""
        open_ = self._mine().join(self._table("staged_decisions", DECISION).select("conversation_id"), "conversation_id", "left_anti").select("conversation_id")
        open_ = written(open_, "open")
        if open_.isEmpty():
            return
        messages = self._table("messages").join(open_, "conversation_id", "left_semi")
        ready = gate.prefilter(gate.signals(messages)).where("prefilter_reason is null").select("conversation_id")
        scores = written(judged(self._texts(ready), self.judge), "judged")
        decided = gate.decide(messages, scores)
        silent = without_text(open_.withColumnRenamed("conversation_id", "id"), messages).select(
            F.col("id").alias("conversation_id"), F.lit("error").alias("decision"), F.lit(0.0).alias("score"), F.lit(1.0).alias("confidence"), F.lit(NO_TEXT).alias("reason"), F.array().cast("array<string>").alias("missing_signals"))
        self._commit(staged_decisions=(written(decided.select(*silent.columns).unionByName(silent), "decisions"), "conversation_id"))

    def _summarise(self) -> None:
        done = self._table("staged_summaries", SUMMARY).select("conversation_id")
        accepted = self._table("staged_decisions", DECISION).where("decision = 'accept'").join(self._mine(), "conversation_id", "left_semi")
        open_ = written(accepted.join(done, "conversation_id", "left_anti").select("conversation_id"), "open")
        if not open_.isEmpty():
            self._commit(staged_summaries=(written(summaries(self._texts(open_), self.summarise), "summaries"), "conversation_id"))

    # Notes

    def _save(self) -> None:
        """Notes, tags and statuses of what this run claimed, in one commit with the end of its claims."""
        mine = written(self._mine(), "mine")
        if mine.isEmpty():
            return
        decisions = self._table("staged_decisions", DECISION).join(mine, "conversation_id", "left_semi")
        made = self._table("staged_summaries", SUMMARY).join(mine, "conversation_id", "left_semi")
        conversations = self._table("conversations")
        own = conversations.join(mine.select(F.col("conversation_id").alias("id")), "id", "left_semi").select(*conversations.columns)
        notes = ensure_columns(self._table("notes", NOTE.simpleString()), NOTE)
        had = notes.groupBy("conversation_id").agg(F.min("id").alias("_old"))
        good = made.where("failed is null").join(had, "conversation_id", "left")
        last = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = with_new_ids(good.where("_old is null"), "conversation_id", "id", last).unionByName(good.where("_old is not null").withColumn("id", F.col("_old")))
        about = own.select(F.col("id").alias("conversation_id"), *(c for c in ("cwd", "project_dir", "source") if c in own.columns))
        fresh = fresh.join(about, "conversation_id")
        folder = F.coalesce(*(F.col(c) for c in ("cwd", "project_dir") if c in about.columns), F.lit(None).cast("string"))
        key = project_key(F.lit(None).cast("array<struct<name:string,url:string>>"), F.lit(None).cast("string"), folder)
        now = F.current_timestamp()
        rows = fresh.withColumns({
            "project_key": key, "scope": F.lit("project"), "source_type": F.lit("imported-conversation"), "embedding_status": F.lit("pending"), "is_edited": F.lit(False), "created_at": now, "updated_at": now,
            **({"source_agent": F.col("source")} if "source" in about.columns else {})})
        rows = written(rows, "notes")
        state = decisions.join(made.select("conversation_id", "failed"), "conversation_id", "left").select(
            F.col("conversation_id").alias("_id"), F.col("decision").alias("_decision"), F.col("score").alias("_score"), F.col("reason").alias("_reason"), F.col("failed").alias("_failed"),
            F.to_json(F.struct("decision", "score", "confidence", "reason", "missing_signals")).alias("_details"))
        status = F.when(F.col("_decision") == "error", "error").when(F.col("_decision") != "accept", "filtered").when(F.col("_failed").isNotNull(), "error").otherwise("summarized")
        stopped = F.col("_decision") != "accept"
        out = own.join(state, own.id == state["_id"]).withColumns({
            "status": status, "experience_gate_reason": F.when(stopped, F.col("_reason")).otherwise(F.col("_failed")), "experience_score": F.when(stopped, F.col("_score")), "experience_gate_details": F.when(stopped, F.col("_details"))})
        tags = rows.select(F.col("id").alias("note_id"), F.explode(normalised_tags(F.col("tags"))).alias("tag"))
        ids = mine.select("conversation_id")
        self._commit(
            conversations=(out.select(*conversations.columns), "id"), notes=(ensure_columns(rows, NOTE).select(*NOTE.names), "id"), note_tags=(tags, "note_id", rows.select(F.col("id").alias("note_id"))),
            claims=(self._claims().where("false"), "conversation_id", ids), staged_decisions=(decisions.where("false"), "conversation_id", ids),
            staged_summaries=(made.where("false").select(*(c.split()[0] for c in SUMMARY.split(", "))), "conversation_id", ids))

    def _embed(self) -> None:
        """Vectors of notes that wait, kept before they are swapped in; meanwhile these notes are syncing."""
        notes = self._table("notes", NOTE.simpleString())
        kept = self._table("staged_vectors", VECTOR).select(F.col("note_id").alias("id")).distinct()
        waiting = written(notes.where(F.col("embedding_status").isin("pending", "failed", "syncing")).join(kept, "id", "left_anti").select(*notes.columns), "waiting")
        if waiting.isEmpty():
            return
        self._commit(notes=(waiting.withColumn("embedding_status", F.lit("syncing")), "id"))
        texts = embedding_text(waiting, self._table("note_tags", "note_id long, tag string"))
        fresh = written(embed(chunk(texts), self.model, failing=True), "vectors")
        self._commit(staged_vectors=(fresh, "note_id"))

    def _swap(self) -> None:
        fresh = self._table("staged_vectors", VECTOR)
        if fresh.isEmpty():
            return
        fresh = written(fresh, "vectors")
        ids = fresh.select("note_id").distinct()
        notes = self._table("notes")
        own = notes.join(ids.select(F.col("note_id").alias("id")), "id", "left_semi").select(*notes.columns)
        columns = ["note_id", "chunk_index", "chunk_text", "vector", "norm"]
        old = self._table("chunks", "note_id long, chunk_index int, chunk_text string, vector array<float>, norm double").select(*columns).join(ids, "note_id", "left_semi").select(*columns)
        done, chunks = swapped_chunks(own, old, fresh)
        self._commit(notes=(done, "id"), chunks=(chunks, "note_id", ids), staged_vectors=(fresh.where("false"), "note_id", ids))

    def _relate(self) -> None:
        """Relations of embedded notes that none has been looked for from, marked in the same commit, so none is looked for twice."""
        notes = self._table("notes", NOTE.simpleString())
        looked = self._table("related_notes", "note_id long").select(F.col("note_id").alias("id"))
        open_ = notes.where("embedding_status = 'done'").select("id").join(looked, "id", "left_anti")
        chunks = self._table("chunks", VECTOR)
        titles = written(chunks.where("chunk_index = 0").join(open_.withColumnRenamed("id", "note_id"), "note_id", "left_semi").select(F.col("note_id").alias("query_id"), "vector"), "titles")
        if titles.isEmpty():
            return
        index = VectorIndex.build(chunks) if self.indexed else None
        candidates = written(relation_candidates(notes, titles, chunks, CANDIDATES, index), "candidates")
        relations = ensure_columns(self._table("relations", RELATION.simpleString()), RELATION)
        found = written(discovered(self.propose(candidates), candidates).select(*KEY, "confidence"), "proposals").dropDuplicates(KEY)
        added = found.join(relations.select(*KEY), KEY, "left_anti").withColumn("_key", F.concat_ws(":", *KEY))
        last = relations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = with_new_ids(added, "_key", "id", last).withColumn("created_at", F.current_timestamp())
        self._commit(relations=(written(ensure_columns(rows.drop("_key"), RELATION).select(*RELATION.names), "relations"), "id"), related_notes=(titles.select(F.col("query_id").alias("note_id")), "note_id"))

