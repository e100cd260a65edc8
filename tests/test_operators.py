import random

import pytest
from pyspark.sql import functions as F

from talus.functions import text
from talus.models import embedder, with_retries
from talus.operators import chunks, gate, graph, memory, notes, turns, vectors
from talus.schemas import CONVERSATION, ensure_columns, migrate_statuses
from talus.store import Store, cascade_delete, changed, insert_ignore, last_of, upsert

MESSAGES = "conversation_id long, sort_order long, type string, content string, has_tool_use boolean"


def made_up(seed, n=60):
    rng = random.Random(seed)
    return [
        (c, k, rng.choice(["user", "assistant", "system"]), "x" * rng.choice([0, 5, 30, 60, 90]) + ("\n" * rng.randint(0, 2)), rng.random() < 0.2)
        for c in range(n) for k in range(rng.randint(1, 25))
    ]


def split(rows):
    """The loop that windows stand in for."""
    out, last_user = [], True
    for row in rows:
        user = row[2] == "user"
        if not out or user and not last_user:
            out.append([])
        out[-1].append(row)
        last_user = user
    return out


def test_turns_and_transcripts_like_the_loop(spark):
    rows = made_up(3)
    messages = spark.createDataFrame(rows, MESSAGES)
    about = messages.select(F.col("conversation_id").alias("id")).distinct().select("id", F.lit("p").alias("project_name"), F.lit("dev").alias("git_branch"))
    budget = 700
    got = {r.conversation_id: r.transcript for r in turns.transcripts(messages, about, budget).collect()}
    header = "项目: p\n分支: dev\n\n--- 对话记录 ---\n\n"
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c and not (r[4] and r[3] == "")]
        if not own:
            assert c not in got
            continue
        parts = split(own)

        def render(turn):
            users = [f"[User]:\n{m[3]}" for m in turn if m[2] == "user"]
            replies = [m[3] for m in turn if m[2] != "user"]
            big = [i for i, r in enumerate(replies) if len(r) > 50]
            shown = [replies[i] for i in dict.fromkeys([big[0], big[-1]])] if big else [r for r in replies if r][:1]
            return "\n\n".join(users + [f"[Assistant]:\n{r}" for r in shown])

        said = lambda t: " ".join(m[3] for m in t if m[2] == "user")
        chars = lambda t: sum(len(m[3]) for m in t if m[2] == "user")
        room = budget - len(header)
        if len(parts) <= 3:
            want = "\n\n".join(map(render, parts))[: max(room, 0)]
        else:
            fixed, middle = [parts[0], *parts[-2:]], parts[1:-2]
            rest, used, picked = max(0, room - sum(len(render(t)) + 2 for t in fixed)), 100 * len(middle), set()
            full = [f"[确认] 用户: {said(t).strip()}" if chars(t) < 20 else render(t) for t in middle]
            score = [0 if chars(t) < 20 else chars(t) * (1 + sum(m[2] != "user" for m in t)) for t in middle]
            for k in sorted(range(len(middle)), key=lambda k: -score[k]):
                if used + len(full[k]) + 2 - 100 <= rest:
                    picked.add(k)
                    used += len(full[k]) + 2 - 100
            brief = []
            for t in middle:
                line = __import__("re").sub("\n+", " ", said(t)).strip()
                brief.append("[跳过] 用户: " + (line[:80] + "..." if len(line) > 80 else line))
            want = "\n\n".join([render(fixed[0]), *(full[k] if k in picked else brief[k] for k in range(len(middle))), render(fixed[1]), render(fixed[2])])
        assert got[c] == header + want


def gate_case(spark, *said, code=False, dims=None):
    rows = [("c", k, t, s, False, code) for k, (t, s) in enumerate(said)]
    messages = spark.createDataFrame(rows, "conversation_id string, sort_order long, type string, content string, has_tool_use boolean, has_code boolean")
    dimensions = spark.createDataFrame([("c", *map(float, dims or (0,) * 5))], "conversation_id string, " + ", ".join(f"{d} double" for d in gate.DIMENSIONS))
    return gate.decide(messages, dimensions).first()


FULL = "We need this because it failed with an error. Verified and fixed; a reusable pattern for next time. "


@pytest.mark.parametrize(
    ("said", "dims", "decision", "reason", "score"),
    [
        ([("user", "hi"), ("assistant", "hello")], None, "reject", "low-signal", 0),
        ([("user", "plain words " * 90), ("assistant", "y")], None, "reject", "missing-problem", 0),
        ([("user", "it failed with an error"), ("assistant", "hmm")], None, "reject", "single-turn-low-density", 0),
        ([("user", "it failed with an error"), ("assistant", "hmm"), ("user", "more"), ("assistant", "hm")], None, "reject", "no-reusable-experience", 0),
        ([("user", FULL), ("assistant", "ok"), ("user", "and more")], (15, 15, 15, 15, 15), "accept", "experience-threshold-met", 83),
        ([("user", FULL), ("assistant", "ok"), ("user", "and more")], (9, 9, 9, 15, 15), "accept", "experience-threshold-met", 65),
        ([("user", FULL), ("assistant", "ok"), ("user", "and more")], (10, 10, 10, 13, 15), "borderline", "experience-threshold-not-met", 66),
        ([("user", FULL), ("assistant", "ok"), ("user", "and more")], (5, 5, 5, 5, 5), "reject", "experience-threshold-not-met", 33),
        ([("user", FULL), ("assistant", "ok"), ("user", "and more")], (20, 20, 20, 20, 20), "accept", "experience-threshold-met", 100),
        ([("user", "an error, a reusable pattern because I try"), ("assistant", "x"), ("user", "more")], (20, 20, 20, 20, 20), "reject", "critical-signal-missing", 88),
        ([("user", "bug error"), ("assistant", "lesson"), ("user", "more")], (0, 0, 0, 0, 0), "reject", "critical-signal-missing", 0),
        ([("user", "问题：服务报错。尝试排查后决策改为重试，因为超时。已修复，经验可复用。" * 4), ("assistant", "好")], (16, 16, 16, 16, 16), "accept", "experience-threshold-met", 88),
    ],
)
def test_gate(spark, said, dims, decision, reason, score):
    got = gate_case(spark, *said, dims=dims)
    assert (got.decision, got.reason, got.score) == (decision, reason, score)


def test_structured_memories(spark):
    schema = "summary string, outcome_type string, root_cause string, resolution string, reusable_patterns array<string>, pitfalls array<string>, decisions array<string>"
    long_ = "a summary that is quite long enough"
    rows = [
        (long_, "fix", "cause", None, None, None, None), (long_, "fix", None, " ", None, None, None), ("短" * 18, "pattern", None, None, ["p"], None, None), ("短" * 17, "decision", "r", None, None, None, [" "]),
        (long_, "pitfall", None, "done", None, ["p"], None), (long_, "pitfall", "r", None, None, ["p"], None),
    ]
    got = [list(r.missing) for r in gate.structured_gaps(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == [[], ["experience_core", "root_cause_or_resolution"], [], ["summary", "decisions"], [], ["pitfalls_and_resolution_or_pattern"]]


def test_chunks_like_the_loop(spark):
    rng = random.Random(5)
    texts = ["\n\n".join("w" * rng.choice([10, 100, 240, 499, 700]) for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n\n\n"]) for _ in range(200)] + ["", " ", "x" * 501]

    def loop(t):
        if len(t) <= 500:
            return [t]
        out, now = [], ""
        for p in __import__("re").split("\n\n+", t):
            if len(now) + len(p) + 2 > 500 and now:
                out.append(now.strip())
                now = p
            else:
                now += ("\n\n" if now else "") + p
        return out + ([now.strip()] if now.strip() else [])

    df = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")
    got = {}
    for r in chunks.chunk(df).orderBy("note_id", "chunk_index").collect():
        got.setdefault(r.note_id, []).append(r.chunk_text)
    assert got == {k: loop(t) for k, t in enumerate(texts)}


def test_search_prefers_chunks_that_are_there(spark):
    rows = [(21, 0, "gone", [1.0, 0.0, 0.0]), (22, 0, "here", [0.9, 0.1, 0.0]), (22, 1, "also", [0.8, 0.3, 0.0]), (23, 0, "far", [0.0, 1.0, 0.0]), (24, 0, "zero", [0.0, 0.0, 0.0])]
    store = vectors.with_norm(spark.createDataFrame(rows, "note_id long, chunk_index int, chunk_text string, vector array<float>"))
    known = spark.createDataFrame([(22, "done"), (23, "done"), (24, "done"), (25, "done"), (26, "pending")], "id long, embedding_status string")
    edges = spark.createDataFrame(
        [(1, 25, 22, "CAUSED_BY", 0.8), (2, 22, 26, "EXTENDS", 0.9), (3, 23, 25, "LEADS_TO", 1.0), (4, 22, 23, "EXTENDS", 0.9), (5, 22, 24, "EXTENDS", 0.4)],
        "id long, source_note_id long, target_note_id long, relation_type string, confidence double",
    )
    got = vectors.search(store, known, edges, [1.0, 0.0, 0.0], k=4, expanded=True).collect()
    assert [(r.note_id, r.via_relation) for r in got] == [(22, None), (25, "CAUSED_BY"), (23, None)] and got[0].chunk_text == "here"
    assert got[1].score == int(got[0].score * 0.7 * 0.8 * 1000 + 0.5) / 1000
    many = vectors.top_chunks_of_many(store, spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, vector array<float>"), k=2, block=1)
    assert {(r.query_id, r["rank"]): r.note_id for r in many.collect()} == {(1, 1): 21, (1, 2): 22, (2, 1): 23, (2, 2): 22}


def test_embedder_is_the_same_everywhere(spark):
    df = spark.createDataFrame([(1, 0, "Red car"), (2, 0, "red CAR"), (3, 0, "blue")], "note_id long, chunk_index int, chunk_text string")
    got = {r.note_id: list(r.vector) for r in vectors.embed(df, embedder("hashing", size=16)).collect()}
    assert got[1] == got[2] != got[3]
    with pytest.raises(LookupError):
        embedder("nobody")
    waits, calls = [], iter([Exception("429 slow"), Exception("429"), "done"])

    def call():
        if isinstance(x := next(calls), Exception):
            raise x
        return x

    assert with_retries(call, sleep=waits.append)() == "done" and waits == [1.0, 2.0]


def request(n, **more):
    base = {"mode": "auto", "goal": f"goal {n}", "summary": "the cache key lacked the tenant id, so tenants met", "outcome_type": "fix", "source_agent": "agent", "source_run_key": f"run{n}",
            "project_key": "git:1", "root_cause": "Cache key", "resolution": "add tenant", "arrays": {"error_signatures": ["E1"]}, "tags": [" Cache ", "cache"]}
    return {"candidate_id": n, **memory.WriteRequest(**(base | more)).row()}


MEMORY = "note_id long, project_key string, scope string, source_type string, title string, summary string, outcome_type string, root_cause string, resolution string, tags array<string>, " + ", ".join(
    f"{a} array<string>" for a in memory.ARRAYS)
RECEIPT = "source_agent string, source_run_key string, decision string, note_id long, merged_into_note_id long, reason string, index_status string"


def test_writeback(spark):
    def frame(*rows):
        names = list(rows[0])
        kinds = {"candidate_id": "long", "tags": "array<string>", **{a: "array<string>" for a in memory.ARRAYS}}
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))

    empty, none = spark.createDataFrame([], MEMORY), spark.createDataFrame([], RECEIPT)
    first = frame(request(1), request(2, summary="fixed it."), request(3, root_cause=None, resolution=None), request(4, mode="manual", scope="global", source_run_key=None, root_cause="other"))
    answers, memories, receipts = memory.write_memories(first, empty, none)
    got = {r.candidate_id: (r.decision, r.note_id) for r in answers.collect()}
    assert got == {1: ("created", 1), 2: ("skipped", None), 3: ("skipped", None), 4: ("created", 2)}
    kept = {r.note_id: r for r in memories.collect()}
    assert kept[1].tags == ["cache"] and (kept[1].scope, kept[1].source_type) == ("project", "agent-writeback") and (kept[2].scope, kept[2].source_type) == ("global", "manual-note")
    assert {r.source_run_key: r.index_status for r in receipts.collect()} == {"run1": "pending", "run2": "completed", "run3": "completed"}
    memories, receipts = spark.createDataFrame(memories.collect(), MEMORY), spark.createDataFrame(receipts.collect(), RECEIPT)
    more = frame(request(5, source_run_key="run1"), request(6, root_cause=" cache KEY ", resolution="Add Tenant", arrays={"error_signatures": ["E1", "E2"], "pitfalls": ["p"]}), request(7, resolution="another way"))
    answers, memories, _ = memory.write_memories(more, memories, receipts)
    got = {r.candidate_id: (r.decision, r.note_id, r.merged_into_note_id) for r in answers.collect()}
    assert got == {5: ("created", 1, None), 6: ("merged", None, 1), 7: ("created", 3, None)}
    one = memories.where("note_id = 1").first()
    assert one.error_signatures == ["E1", "E2"] and one.pitfalls == ["p"] and one.summary.count("Evidence update:") == 1 and one.root_cause == " cache KEY "


@pytest.mark.parametrize("bad", [{"source_run_key": None}, {"scope": "global"}, {"goal": " "}, {"outcome_type": "x"}, {"arrays": {"x": []}}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        request(1, **bad)


def test_project_keys(spark):
    urls = ["git@GitHub.com:Org/Repo.git", "https://github.com/org/repo/", "ssh://git@github.com/Org/Repo.GIT", "https://github.com/org/other"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(memory.remote_path(F.col("u")).alias("k")).collect()]
    assert got == ["github.com/org/repo"] * 3 + ["github.com/org/other"]
    none = F.lit(None).cast("string")
    remotes = F.array(F.struct(F.lit("fork").alias("name"), F.lit(urls[3]).alias("url")), F.struct(F.lit("origin").alias("name"), F.lit(urls[0]).alias("url")))
    row = spark.range(1).select(
        memory.project_key(remotes, none, none).alias("a"), memory.project_key(F.lit(None).cast("array<struct<name:string,url:string>>"), F.lit("C:\\x"), none).alias("b"),
        memory.short_digest(F.lit("github.com/org/repo")).alias("c"),
    ).first()
    assert row.a == f"git:{row.c}" and row.b.startswith("path:") and len(row.b) == 29


def test_recall(spark):
    hits = spark.createDataFrame([(11, "t", "c", 0.9, None, 1), (12, "t", "c", 0.8, "EXTENDS", 2), (13, "hit", "chunk", 0.7, None, 3), (14, "t", "c", 0.6, None, 4)], "note_id long, title string, chunk_text string, score double, via_relation string, rank int")
    rows = [(11, "own", "s", "k", "project"), (12, "all", "s", None, "global"), (13, "", "", "alias", None), (14, "x", "s", "foreign", "project")]
    about = spark.createDataFrame(rows, "note_id long, title string, summary string, project_key string, scope string").withColumns(
        {"outcome_type": F.lit("fix"), "pitfalls": F.lit(None).cast("array<string>"), "reusable_patterns": F.lit(None).cast("array<string>")})
    edges = spark.createDataFrame([(1, 11, 12, "EXTENDS", 1.0), (2, 12, 11, "EXTENDS", 1.0)], "id long, source_note_id long, target_note_id long, relation_type string, confidence double")
    keys = memory.key_set(spark.createDataFrame([("alias", "k")], "alias_key string, canonical_key string"), "k")
    got = memory.recall(hits, about, edges, keys, 5, 1).orderBy("bucket", "position").collect()
    assert [(r.bucket, r.note_id, r.title, r.summary) for r in got] == [("global", 12, "all", "s"), ("project", 11, "own", "s"), ("project", 13, "hit", "chunk")]
    assert got[1].related_note_ids == [12, 12] and got[0].why_relevant.endswith("EXTENDS") and memory.recall_size(1, 1) == 6
    assert memory.recall_reason(hits.where("false"), "k") == "no-matches" and memory.recall_reason(hits, None) == "no-project-key" and memory.recall_reason(hits, "k") == "ok"


def test_relations(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, title string")
    edges = spark.createDataFrame([], "id long, source_note_id long, target_note_id long, relation_type string, confidence double, description string")
    edges = graph.create_relation(edges, known, 1, 2, "EXTENDS")
    assert graph.create_relation(edges, known, 1, 2, "EXTENDS").count() == 1 and graph.note_relations(edges, known, 2).first().source_title == "a"
    for bad in ((1, 1, "EXTENDS", ValueError), (1, 2, "LIKES", ValueError), (1, 9, "EXTENDS", LookupError)):
        with pytest.raises(bad[3]):
            graph.create_relation(edges, known, *bad[:3])
    found = [(1, k, "EXTENDS", 0.5 + k / 100 + 0.001, k) for k in range(2, 10)] + [(1, 10, "EXTENDS", 0.49, 0), (1, 11, "NO", 0.9, 0)]
    proposals = spark.createDataFrame(found, "source_note_id long, target_note_id long, relation_type string, confidence double, position int")
    kept = graph.discovered(proposals, proposals.where("target_note_id <> 3").select("source_note_id", "target_note_id"))
    assert sorted(r.target_note_id for r in kept.collect()) == [2, 4, 5, 6, 7]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.tables() == [] and store.read("a") is None
    store.commit({"a": spark.range(3), "b": spark.range(1)})
    store.commit({"a": spark.range(5)})
    assert store.tables() == ["a", "b"] and store.read("a").count() == 5 and store.read("b").count() == 1
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    new = spark.createDataFrame([(2, "p", 1), (2, "q", 2), (3, "r", 1)], "k long, v string, n long")
    assert dict(upsert(old, new, ["k"], "n").collect()) == {1: "x", 2: "q", 3: "r"}
    assert dict(insert_ignore(old, new, ["k"], "n").collect()) == {1: "x", 2: "y", 3: "r"}
    assert last_of(new, ["k"], "n").count() == 2
    marks = spark.createDataFrame([(1, None), (2, "y"), (4, "n")], "k long, v string")
    assert sorted(r.k for r in changed(marks, old, ["k"], ["v"]).collect()) == [1, 4]


def test_cascade_reaches_receipts(spark):
    f = spark.createDataFrame
    tables = {
        "conversations": f([("c1",), ("c2",)], "id string"), "messages": f([("c1",), ("c2",)], "conversation_id string"), "notes": f([(1, "c1"), (2, "c2")], "id long, conversation_id string"),
        "note_tags": f([(1, "t"), (2, "t")], "note_id long, tag string"), "note_relations": f([(1, 2), (2, 2)], "source_note_id long, target_note_id long"),
        "writeback_receipts": f([(1, None), (2, 1)], "note_id long, merged_into_note_id long"),
    }
    left = cascade_delete(tables, f([("c1",)], "id string"))
    assert {k: v.count() for k, v in left.items()} == {"conversations": 1, "messages": 1, "notes": 1, "note_tags": 1, "note_relations": 1, "writeback_receipts": 2}
    assert sorted(map(tuple, left["writeback_receipts"].collect()), key=repr) == [(2, None), (None, None)]


def test_columns_added_later(spark):
    rows = spark.createDataFrame([("a", "error", " Low-Signal "), ("b", "error", "timeout"), ("c", "imported", None)], "ID string, status string, experience_gate_reason string").withColumn("more", F.lit(1))
    full = ensure_columns(rows, CONVERSATION)
    assert full.columns == [*CONVERSATION.names, "more"]
    assert {r.id: r.status for r in migrate_statuses(full).collect()} == {"a": "filtered", "b": "error", "c": "imported"}


def test_text_functions(spark):
    row = spark.createDataFrame([("\u3000 a\u00a0\n", "C:\\x\\y\\", "file:///c%20d+e", -2.5)], "a string, p string, u string, x double").select(
        text.trim_all(F.col("a")), text.last_segment(F.col("p")), text.file_uri_path(F.col("u")), text.round_up_ties(F.col("x"), 0), text.dense_length(F.col("a"))).first()
    assert tuple(row) == ("a", "y", "c d+e", -2.0, 1)


def test_backfill(spark):
    columns = "id long, conversation_id string, project_key string, scope string, source_type string, source_agent string"
    rows = spark.createDataFrame([(1, "c", "old", None, None, "unknown"), (2, "c", "k", "global", "manual-note", "x"), (3, "m", None, None, None, None)], columns)
    about = spark.createDataFrame([("c", "codex", "new"), ("m", notes.SYNTHETIC, "no")], "id string, source string, derived_project_key string")
    out, aliases = notes.backfill(rows, about, {"codex": "codex"})
    assert sorted(map(tuple, out.collect())) == [(1, "c", "new", "project", "imported-conversation", "codex"), (2, "c", "k", "global", "manual-note", "x"), (3, "m", None, None, None, None)]
    assert [tuple(r) for r in aliases.collect()] == [("old", "new")]


def test_pages_behind_a_row(spark, tmp_path):
    """Walking by the last row gives the order of offsets, through ties and nulls; the filter reaches the scan."""
    data = [(k, None if k % 7 == 0 else k // 5 % 9) for k in range(120)]
    spark.createDataFrame(data, "id long, at int").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    walked, last = [], None
    while got := notes.page_behind(rows, "at", "id", last, limit=25).collect():
        walked += [(r.id, r.at) for r in got]
        last = (got[-1].at, got[-1].id)
    assert walked == sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    plan = notes.page_behind(rows, "at", "id", (3, 40), limit=25)._jdf.queryExecution().toString()
    assert "LessThan(at,3)" in plan and "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        notes.page_behind(rows, "at", "id", limit=-1)
