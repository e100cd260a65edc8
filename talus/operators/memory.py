"""Project keys, recall for a task, and idempotent writeback of memories, set at a time.

Memories: note_id, project_key, scope, title, summary, outcome_type, root_cause, resolution and the ARRAYS.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import blank, first_non_blank, non_blank, normalised_tags, round_up_ties, trim_all, united, united_values
from talus.operators import vectors
from talus.operators.gate import structured_gaps
from talus.operators.graph import adjacency
from talus.operators.vectors import DECAY, LEAST_CONFIDENCE, both_ways
from talus.schemas import OUTCOMES
from talus.shared import written
from talus.store import insert_ignore, with_new_ids

ARRAYS = ("pitfalls", "reusable_patterns", "decisions", "key_conclusions", "files_touched", "error_signatures")
MODES, SCOPES = ("auto", "manual"), ("project", "global")


# Project keys


def remote_path(url: Column) -> Column:
    """host/path of a git remote, in lower case, without .git and outer slashes; ssh and URL forms agree."""
    plain = F.regexp_replace(trim_all(url), r"(?i)\.git$", "")
    ssh = r"^git@([^:]+):(.+)$"
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parsed = F.concat(host, F.lit("/"), F.lower(F.regexp_replace(path, "^/+|/+$", "")))
    scp = F.concat(F.lower(F.regexp_extract(plain, ssh, 1)), F.lit("/"), F.regexp_replace(F.lower(F.regexp_extract(plain, ssh, 2)), "/+$", ""))
    return F.when(plain.rlike(ssh), scp).otherwise(parsed)


def short_digest(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(24))


def project_key(remotes: Column, git_root: Column, folder: Column) -> Column:
    """git:, path: or cwd: and 24 hex digits. remotes: array of (name, url); origin goes first, else the first by name."""
    origin = F.filter(remotes, lambda r: r["name"] == "origin")
    chosen = F.coalesce(F.try_element_at(origin, F.lit(1)), F.try_element_at(F.array_sort(remotes), F.lit(1)))["url"]
    slashes = lambda p: F.replace(p, F.lit("\\"), F.lit("/"))
    return F.coalesce(
        F.concat(F.lit("git:"), short_digest(remote_path(chosen))), F.concat(F.lit("path:"), short_digest(slashes(git_root))),
        F.concat(F.lit("cwd:"), short_digest(slashes(folder))),
    )


def canonical_keys(rows: DataFrame, aliases: DataFrame, key: str = "project_key") -> DataFrame:
    """rows with their key's canonical form (alias_key, canonical_key), itself if it has none."""
    known = aliases.select(F.col("alias_key").alias(key), F.col("canonical_key").alias("_canonical"))
    return rows.join(known, key, "left").withColumn("canonical_key", F.coalesce("_canonical", key)).drop("_canonical")


def key_set(aliases: DataFrame, canonical: str) -> DataFrame:
    """(project_key): the key and all its aliases."""
    spark = aliases.sparkSession
    own = spark.range(1).select(F.lit(canonical).alias("project_key"))
    return own.union(aliases.where(F.col("canonical_key") == canonical).select("alias_key")).distinct()


# Recall


def recall_size(project_limit: int = 5, global_limit: int = 3) -> int:
    """How many chunks to ask for: three for each memory that may come back."""
    return max((project_limit + global_limit) * 3, 1)


def key_sets(tasks: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, project_key): the canonical key of each task's project and all its aliases; none for a task without a key."""
    own = canonical_keys(tasks.select("query_id", "project_key").where(non_blank(F.col("project_key")).isNotNull()), aliases, "project_key").select("query_id", "canonical_key")
    more = own.join(aliases.select("canonical_key", "alias_key"), "canonical_key").select("query_id", F.col("alias_key").alias("project_key"))
    return own.select("query_id", F.col("canonical_key").alias("project_key")).unionByName(more).distinct()


def recall(hits: DataFrame, notes: DataFrame, relations: DataFrame, keys: DataFrame, project_limit: int = 5, global_limit: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Memories of both buckets, in rank order: bucket, position, note_id, title, summary, outcome_type, pitfalls,
    reusable_patterns, related_note_ids, score, why_relevant.

    hits: note_id, title, chunk_text, score, via_relation, rank. A project memory is of one of ``keys``; one without a
    scope counts as the project's. Limits hold after filtering, so fewer can come back than were hit. ``by`` names the
    columns of hits and keys that tell tasks apart; limits hold for each.
    """
    meta = notes.select("note_id", *(F.col(c).alias(f"_{c}") for c in ("title", "summary", "project_key", "scope", "outcome_type", "pitfalls", "reusable_patterns")))
    own = keys.select(*by, F.col("project_key").alias("_project_key"), F.lit(True).alias("_own")).distinct()
    rows = hits.join(meta, "note_id").join(own, [*by, "_project_key"], "left")
    scope = F.coalesce(non_blank(F.col("_scope")), F.lit("project"))
    bucket = F.when((scope == "project") & F.col("_own"), "project").when(scope == "global", "global")
    rows = rows.withColumn("bucket", bucket).where("bucket is not null")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("rank")))
    rows = rows.where(F.col("position") <= F.when(F.col("bucket") == "project", project_limit).otherwise(global_limit))
    # Relations are looked up of what comes back, once a note however many tasks it comes back for.
    kept = rows.select("note_id").distinct()
    near = relations.join(kept.withColumnRenamed("note_id", "source_note_id"), "source_note_id", "left_semi").unionByName(
        relations.join(kept.withColumnRenamed("note_id", "target_note_id"), "target_note_id", "left_semi")
    ).distinct()
    empty, no_ids = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    return rows.join(adjacency(near), "note_id", "left").select(
        *by, "bucket", "position", "note_id", F.coalesce(F.nullif("_title", F.lit("")), "title").alias("title"),
        F.coalesce(F.nullif("_summary", F.lit("")), "chunk_text").alias("summary"), F.col("_outcome_type").alias("outcome_type"),
        F.coalesce("_pitfalls", empty).alias("pitfalls"), F.coalesce("_reusable_patterns", empty).alias("reusable_patterns"),
        F.coalesce("related_ids", no_ids).alias("related_note_ids"), "score",
        F.when(F.col("via_relation").isNotNull(), F.concat(F.lit("Matched via relation "), F.col("via_relation"))).otherwise("Matched by semantic similarity").alias("why_relevant"),
    )


def recall_many(
    tasks: DataFrame, chunks: DataFrame, notes: DataFrame, about: DataFrame, relations: DataFrame, aliases: DataFrame, project_limit: int = 5, global_limit: int = 3, index: vectors.VectorIndex | None = None
) -> tuple[DataFrame, DataFrame]:
    """Recall for many tasks (query_id, vector, project_key) in one plan: (memories, reasons).

    memories are those of ``recall`` with query_id, equal to one call a task; reasons (query_id, reason) has a row for
    every task: no-project-key, no-matches or ok. query_id tells tasks apart. A task without a key gets global memories
    alone, one without a vector none. notes: id, title,
    embedding_status; about: the memories' own columns with note_id. Hits go by task through every window, so a key or a
    memory that a third of all tasks share fills no task of its own.
    """
    asked = tasks.where(F.col("vector").isNotNull())
    hits = vectors.search_many(chunks, notes, relations, asked.select("query_id", "vector"), recall_size(project_limit, global_limit), index)
    titled = hits.join(notes.select(F.col("id").alias("note_id"), "title"), "note_id")
    memories = written(recall(titled, about, relations, key_sets(asked, aliases), project_limit, global_limit, by=("query_id",)), "recalled")
    found = tasks.select("query_id", "project_key").join(memories.select("query_id", F.lit(True).alias("_met")).distinct(), "query_id", "left")
    reason = F.when(non_blank(F.col("project_key")).isNull(), "no-project-key").when(F.col("_met"), "ok").otherwise("no-matches")
    return memories, found.select("query_id", reason.alias("reason"))


def recall_reason(memories: DataFrame, key: str | None) -> str:
    return "no-project-key" if not key else "no-matches" if memories.isEmpty() else "ok"


# Writeback


@dataclass
class WriteRequest:
    """One memory to write back. Raises ValueError for what the rules across fields forbid."""

    mode: str
    goal: str
    summary: str
    outcome_type: str
    source_agent: str
    source_run_key: str | None = None
    scope: str | None = None
    project_key: str | None = None
    root_cause: str | None = None
    resolution: str | None = None
    arrays: dict[str, list[str]] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.outcome_type not in OUTCOMES:
            raise ValueError("unknown mode or outcome type")
        if self.scope is not None and self.scope not in SCOPES:
            raise ValueError("unknown scope")
        if not self.goal.strip() or not self.summary.strip():
            raise ValueError("goal and summary must not be blank")
        if self.mode == "auto" and not (self.source_run_key or "").strip():
            raise ValueError("automatic writes need a run key")
        if self.mode == "auto" and self.scope == "global":
            raise ValueError("automatic writes stay in their project")
        if unknown := set(self.arrays) - set(ARRAYS):
            raise ValueError(f"unknown lists: {sorted(unknown)}")

    def row(self) -> dict[str, Any]:
        manual = self.mode == "manual"
        return {
            "mode": self.mode, "source_agent": self.source_agent, "source_run_key": self.source_run_key, "project_key": self.project_key,
            "scope": (self.scope or "project") if manual else "project", "source_type": "manual-note" if manual else "agent-writeback",
            "title": re.sub(r"\s+", " ", self.goal).strip(), "summary": self.summary, "outcome_type": self.outcome_type,
            "root_cause": self.root_cause, "resolution": self.resolution, "tags": self.tags, **{a: self.arrays.get(a, []) for a in ARRAYS},
        }


def knowledge_delta() -> Column:
    """First text of a memory that says something: resolution, root cause, then the lists in turn."""
    lists = F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in ("reusable_patterns", "decisions", "pitfalls", "key_conclusions", "error_signatures")))
    return F.coalesce(first_non_blank(F.col("resolution"), F.col("root_cause")), F.try_element_at(F.filter(lists, lambda x: ~blank(x)), F.lit(1)))


def decide_writes(candidates: DataFrame, existing: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """candidates (candidate_id and a memory's columns) with decision, reason, target_note_id, each as if it came alone.

    skipped: a summary under 24 characters, ``fixed it.``, or nothing learnt. merged: the first existing memory (by
    ``rank``) of the same project with the same root cause and resolution (two blank ones are the same) that shares an
    error signature. Else created. With ``near`` (candidate_id, note_id, rank) only those memories are looked at, in its
    order. Without, both sides are taken apart by error signature and joined on all four values, so a frequent cause
    meets only what shares a signature with it, and a partial minimum leaves one row a candidate.
    """
    left = candidates.withColumn("_skip", _says_nothing())
    first = _first_matches(_signed(left.where("not _skip"), F.col("candidate_id")), existing, near).select("candidate_id", F.col("first.note_id").alias("target_note_id"))
    return _with_decision(left.join(first, "candidate_id", "left"), F.col("target_note_id").isNotNull()).select(*candidates.columns, "decision", "reason", "target_note_id")


#: What two memories must share to be merged.
MATCH = ["_project", "_cause", "_fix", "_sign"]
#: Ranges of candidates that a frequent signature's requests are dealt into.
RANGES = 128


def _says_nothing() -> Column:
    summary = F.lower(trim_all(F.coalesce("summary", F.lit(""))))
    return (F.length(summary) < 24) | (summary == "fixed it.") | knowledge_delta().isNull()


def _signed(rows: DataFrame, *columns: Column) -> DataFrame:
    """One row for each error signature of a memory: ``columns`` and MATCH."""
    norm = lambda c: F.lower(trim_all(non_blank(F.col(c))))
    return rows.select(
        *columns, F.col("project_key").alias("_project"), norm("root_cause").alias("_cause"), F.coalesce(norm("resolution"), F.lit("")).alias("_fix"), F.explode(F.array_distinct("error_signatures")).alias("_sign"))


def _first_matches(mine: DataFrame, existing: DataFrame, near: DataFrame | None) -> DataFrame:
    """(candidate_id, first): rank and note_id of the first existing memory that each candidate matches."""
    right = _signed(existing.where(~blank(F.col("project_key"))), F.col("note_id"), *([] if near is not None else [F.col("rank")]))
    if near is not None:
        met = mine.join(near.select("candidate_id", "note_id", "rank"), "candidate_id").join(right, ["note_id", *MATCH])
    else:  # of equal memories only the first can be chosen
        met = mine.join(right.groupBy(*MATCH).agg(F.min(F.struct("rank", "note_id")).alias("x")).select(*MATCH, "x.rank", "x.note_id"), MATCH)
    return met.groupBy("candidate_id").agg(F.min(F.struct(F.col("rank").cast("long").alias("rank"), "note_id")).alias("first"))


def _taken_in(signed: DataFrame, rows: DataFrame, near: DataFrame) -> DataFrame:
    """(candidate_id, _taken): the first found memory that has a signature of the candidate by taking in an earlier one."""
    since = rows.where("best.made = 0").groupBy(F.col("best.id").alias("note_id"), *MATCH).agg(F.min("candidate_id").alias("_since"))
    met = signed.join(near.select("candidate_id", "note_id", "rank"), "candidate_id").join(since, ["note_id", *MATCH]).where("_since < candidate_id")
    return met.groupBy("candidate_id").agg(F.min(F.struct(F.lit(0).alias("made"), F.col("rank").cast("long").alias("rank"), F.col("note_id").alias("id"))).alias("_taken"))


def _with_decision(rows: DataFrame, merged: Column) -> DataFrame:
    decision = F.when(F.col("_skip"), "skipped").when(merged, "merged").otherwise("created")
    reason = F.when(F.col("_skip"), "low-signal").when(merged, "merged-into-existing-memory").otherwise("created-new-memory")
    return rows.withColumn("decision", decision).withColumn("reason", reason)


def decide_batch(candidates: DataFrame, existing: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """candidates with decision, reason, target_note_id, target_candidate_id, as if written one after another by candidate_id.

    A memory that an earlier candidate created can be merged into by a later one (target_candidate_id), and one that took
    in a candidate has its signatures too. With ``near``, memories of the batch count as found after those of ``near``;
    as each candidate then has an order of its own, rounds grow with the length of the longest chain.

    What a candidate is merged into is the smallest of: its first existing match, itself, and what any earlier candidate
    with which it shares all of MATCH was merged into. So rounds of a running minimum by signature, each followed by a
    look at what the found candidate itself was merged into, end after a number of rounds that grows with the logarithm
    of the longest chain. A frequent signature is dealt into ranges of candidates; only a count reaches the driver.
    """
    left = candidates.withColumn("_skip", _says_nothing())
    bounds = left.select(F.col("candidate_id").cast("double").alias("c")).approxQuantile("c", [k / RANGES for k in range(1, RANGES)], 0.001)
    signed = _signed(left.where("not _skip"), F.col("candidate_id")).where(~blank(F.col("_project")) & F.col("_cause").isNotNull() & F.col("_sign").isNotNull())
    limits = F.array(*(F.lit(b) for b in sorted(set(bounds)))).cast("array<double>")
    signed = written(signed.withColumn("_range", F.size(F.filter(limits, lambda b: b < F.col("candidate_id")))), "signed")
    own = F.struct(F.lit(1).alias("made"), F.col("candidate_id").alias("rank"), F.col("candidate_id").alias("id"))
    found = _first_matches(signed.drop("_range"), existing, near).select("candidate_id", F.struct(F.lit(0).alias("made"), F.col("first.rank").alias("rank"), F.col("first.note_id").alias("id")).alias("_found"))
    ids = signed.select("candidate_id").distinct()
    best = written(ids.join(found, "candidate_id", "left").select("candidate_id", F.least(own, "_found").alias("best")), "best")
    start = best
    while True:
        rows = signed.join(best, "candidate_id").withColumn("_passed", F.when(F.col("best.made") == 1, F.col("best")) if near is not None else F.col("best"))
        before = Window.partitionBy(*MATCH, "_range").orderBy("candidate_id").rowsBetween(Window.unboundedPreceding, -1)
        ranges = rows.groupBy(*MATCH, "_range").agg(F.min("_passed").alias("_least"))
        earlier = Window.partitionBy(*MATCH).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
        ranges = ranges.select(*MATCH, "_range", F.min("_least").over(earlier).alias("_earlier"))
        prior = rows.withColumn("_before", F.min("_passed").over(before)).join(ranges, [*MATCH, "_range"]).groupBy("candidate_id").agg(F.min(F.least("_before", "_earlier")).alias("_prior"))
        if near is not None:
            after = start.join(prior, "candidate_id").join(_taken_in(signed, rows, near), "candidate_id", "left").select("candidate_id", F.least("best", "_prior", "_taken").alias("next"))
            after = written(after, "step").join(best, "candidate_id")
        else:
            step = written(best.join(prior, "candidate_id").select("candidate_id", "best", F.least("best", "_prior").alias("next")), "step")
            then = step.select(F.col("candidate_id").alias("_of"), F.col("next").alias("_then"))
            after = step.join(then, (step["next.made"] == 1) & (step["next.id"] == then["_of"]), "left").select("candidate_id", "best", F.least("next", "_then").alias("next"))
        after = written(after, "best")
        best = after.select("candidate_id", F.col("next").alias("best"))
        if after.where("next <> best").isEmpty():
            break
    out = left.join(best, "candidate_id", "left")
    made = F.col("best.made") == 1
    target = F.when(~made & ~F.col("_skip"), F.col("best.id"))
    into = F.when(made & ~F.col("_skip") & (F.col("best.id") != F.col("candidate_id")), F.col("best.id"))
    out = out.withColumn("target_note_id", target).withColumn("target_candidate_id", into)
    return _with_decision(out, F.col("target_note_id").isNotNull() | F.col("target_candidate_id").isNotNull()).select(*candidates.columns, "decision", "reason", "target_note_id", "target_candidate_id")


def merge_memories(existing: DataFrame, merges: DataFrame) -> DataFrame:
    """existing memories with those of ``merges`` (candidate_id, target_note_id and a memory's columns) worked in.

    Several merges into one memory are worked in one after another, in order of candidate_id: summaries are appended, the
    last cause and resolution hold, lists are united. code_snippets, where both sides have them, are united by value.
    """
    values = ["summary", "root_cause", "resolution", "tags", *ARRAYS] + [c for c in ("code_snippets",) if c in existing.columns and c in merges.columns]
    new = merges.groupBy(F.col("target_note_id").alias("note_id")).agg(F.array_sort(F.collect_list(F.struct("candidate_id", *values))).alias("_m"))
    both = existing.join(new, "note_id", "left")
    hit = F.col("_m").isNotNull()

    def of(name: str) -> Column:
        return F.transform("_m", lambda m: m[name])

    def last(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(of(name), lambda x: ~blank(x)), F.lit(-1)), name)

    def lists(name: str) -> Column:
        return F.flatten(F.filter(of(name), lambda x: x.isNotNull()))

    changed = {
        "summary": F.concat("summary", F.array_join(F.transform(of("summary"), lambda x: F.concat(F.lit("\n\nEvidence update:\n"), x)), "")),
        "root_cause": last("root_cause"), "resolution": last("resolution"),
        "tags": normalised_tags(united(F.col("tags"), lists("tags"))), **{a: united(F.col(a), lists(a)) for a in ARRAYS},
    }
    if "code_snippets" in values:
        changed["code_snippets"] = united_values(F.col("code_snippets"), lists("code_snippets"))
    return both.select(*(F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in existing.columns))


def write_memories(requests: DataFrame, memories: DataFrame, receipts: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, memories, receipts) after a batch of requests, one response a request, in order of candidate_id.

    A request of mode auto whose (source_agent, source_run_key) has a receipt, or that an earlier request of the batch
    also has, is answered as that one and changes nothing. Invalid memories are skipped before any matching. A request sees
    what earlier ones of the batch created (``decide_batch``). Every merge is worked in and answered, several into one
    memory one after another. New ids go on from the largest.
    near: the memories each request is compared with (``nearest_memories``); all of its project where not given.
    Receipts of what was written are pending until ``completed_receipts`` finds it embedded.
    """
    keys = ["source_agent", "source_run_key"]
    answer = ["decision", "note_id", "merged_into_note_id", "reason"]
    auto = F.col("mode") == "auto"
    first = F.row_number().over(Window.partitionBy(*keys, F.when(~auto, F.col("candidate_id"))).orderBy("candidate_id"))
    ranked = requests.withColumn("_nth", first)
    known = ranked.where(auto).join(receipts.select(*keys), keys, "left_semi").select("candidate_id")
    fresh = structured_gaps(ranked.where("_nth = 1").drop("_nth").join(known, "candidate_id", "left_anti"))
    decided = decide_batch(fresh.where(F.size("missing") == 0).drop("missing"), memories.withColumn("rank", F.col("note_id")), near)
    nothing = F.lit(None).cast("long")
    invalid = fresh.where(F.size("missing") > 0).drop("missing").select(
        "*", F.lit("skipped").alias("decision"), F.lit("low-signal").alias("reason"), nothing.alias("target_note_id"), nothing.alias("target_candidate_id"))
    decided = written(decided.unionByName(invalid), "decided")
    last = memories.agg(F.coalesce(F.max("note_id"), F.lit(0))).first()[0]
    created = with_new_ids(decided.where("decision = 'created'"), "candidate_id", "note_id", last)
    made = created.select(F.col("candidate_id").alias("target_candidate_id"), F.col("note_id").alias("_made"))
    merges = decided.where("decision = 'merged'").join(made, "target_candidate_id", "left").withColumn("target_note_id", F.coalesce("target_note_id", "_made")).drop("_made")
    new = created.withColumn("tags", normalised_tags(F.col("tags")))
    new = new.select(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in memories.columns))
    all_memories = merge_memories(memories.unionByName(new), merges)
    none = F.lit(None).cast("long")
    parts = [(created, F.col("note_id"), none), (merges, none, F.col("target_note_id")), (decided.where("decision = 'skipped'"), none, none)]
    done = reduce(DataFrame.unionByName, [d.select("candidate_id", "decision", n.alias("note_id"), m.alias("merged_into_note_id"), "reason", "mode", *keys) for d, n, m in parts])
    receipt = done.where(auto).select(*keys, *answer, F.when(F.col("decision") == "skipped", "completed").otherwise("pending").alias("index_status"))
    all_receipts = receipts.unionByName(receipt)
    repeated = ranked.where(auto).select("candidate_id", *keys).join(done.select("candidate_id"), "candidate_id", "left_anti").join(all_receipts.select(*keys, *answer), keys)
    return done.select("candidate_id", *answer).unionByName(repeated.select("candidate_id", *answer)), all_memories, all_receipts


def completed_receipts(receipts: DataFrame, chunks: DataFrame) -> DataFrame:
    """receipts with those completed that are pending and whose memory has vectors (chunks: note_id)."""
    have = chunks.select(F.col("note_id").alias("_have")).distinct()
    out = receipts.join(have, F.coalesce("note_id", "merged_into_note_id") == F.col("_have"), "left")
    status = F.when((F.col("index_status") == "pending") & F.col("_have").isNotNull(), "completed").otherwise(F.col("index_status"))
    return out.select(*(status.alias(c) if c == "index_status" else F.col(c) for c in receipts.columns))


def to_index(receipts: DataFrame) -> DataFrame:
    """(note_id): memories whose receipts are pending, to embed now or, after a run that died, again."""
    return receipts.where("index_status = 'pending'").select(F.coalesce("note_id", "merged_into_note_id").alias("note_id")).where("note_id is not null").distinct()


def request_text() -> Column:
    """What of a request is embedded to find memories near it: goal, summary, cause, resolution and the lists, a line each."""
    lists = F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in ("reusable_patterns", "decisions", "pitfalls", "error_signatures")))
    texts = F.concat(F.array("title", "summary", "root_cause", "resolution"), lists)
    return F.array_join(F.filter(texts, lambda x: x.isNotNull() & (x != "")), "\n")


def nearest_memories(hits: DataFrame, relations: DataFrame, notes: DataFrame) -> DataFrame:
    """(candidate_id, note_id, score, rank): the memories that requests found (hits: candidate_id, note_id, score), and those one relation away.

    The best chunk of each memory counts; a neighbour's score is its hit's times 0.7 and the confidence, 0.5 at least.
    """
    ready = notes.where("embedding_status = 'done'").select(F.col("id").alias("note_id"))
    direct = hits.join(ready, "note_id", "left_semi").groupBy("candidate_id", "note_id").agg(F.max("score").alias("score"))
    edges = both_ways(relations.where(F.col("confidence") >= LEAST_CONFIDENCE)).select("note_id", "linked_id", "confidence")
    reached = direct.join(edges, "note_id").select("candidate_id", F.col("linked_id").alias("note_id"), round_up_ties(F.col("score") * DECAY * F.col("confidence"), 3).alias("score"))
    reached = reached.join(ready, "note_id", "left_semi").join(direct.select("candidate_id", "note_id"), ["candidate_id", "note_id"], "left_anti")
    every = direct.unionByName(reached.groupBy("candidate_id", "note_id").agg(F.max("score").alias("score")), allowMissingColumns=True)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("score"), "note_id")))


def edges_of_created(responses: DataFrame, near: DataFrame) -> DataFrame:
    """(source_note_id, target_note_id, relation_type, confidence) from each memory just made to the three most similar, 0.75 at least."""
    made = responses.where("decision = 'created'").select("candidate_id", F.col("note_id").alias("source_note_id"))
    hits = near.where("score >= 0.75").groupBy("candidate_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "note_id", "score"))), lambda x: F.struct(x["note_id"].alias("note_id"), x["score"].alias("score"))).alias("hits"))
    edges = made.join(hits, "candidate_id").select("source_note_id", F.explode(similar_edges(F.col("source_note_id"), F.col("hits"))).alias("e"))
    return edges.select("source_note_id", "e.target_note_id", "e.relation_type", "e.confidence")


def similar_edges(note_id: Column, hits: Column) -> Column:
    """Up to three (target, type, confidence) for a new memory from its hits (note_id, score), best first."""
    near = F.slice(F.array_distinct(F.transform(F.filter(hits, lambda h: (h["score"] >= 0.75) & (h["note_id"] != note_id)), lambda h: h["note_id"])), 1, 3)
    return F.transform(near, lambda n: F.struct(n.alias("target_note_id"), F.lit("SIMILAR_TO").alias("relation_type"), F.lit(0.75).alias("confidence")))


def origin_conversations(conversations: DataFrame, origins: DataFrame, source: str) -> DataFrame:
    """conversations with one for each origin (origin_id, project_name) of written-back memories, made where it lacks."""
    new = origins.select(F.concat(F.lit("memory:"), "origin_id").alias("id"), F.lit(source).alias("source"), "project_name", F.lit("summarized").alias("status"))
    return insert_ignore(conversations, new, ["id"])
