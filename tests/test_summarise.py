import json

from pyspark.sql import functions as F

from talus.config import Config, seed
from talus.operators import gate, memory, summarise, vectors
from talus.schemas import CONVERSATION, ensure_columns
from talus.store import Store

GOOD = "We need this because it failed with an error. Verified and fixed; a reusable pattern for next time. "


def test_summaries_only_of_what_passes(spark, tmp_path):
    paths = iter(range(99))

    def written(df):
        path = f"{tmp_path}/{next(paths)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = [(i, "p", "imported") for i in ("good", "bad", "low", "broken", "done")] + [("old", "p", "summarized")]
    conversations = ensure_columns(spark.createDataFrame(rows, "id string, project_name string, status string"), CONVERSATION)
    said = [(c, k, "user" if k % 2 == 0 else "assistant", ("hi" if c == "bad" else f"{GOOD} {c}"), False) for c, *_ in rows for k in range(4)]
    messages = spark.createDataFrame(said, "conversation_id string, sort_order long, type string, content string, has_tool_use boolean")
    have = spark.createDataFrame([(7, "done")], "id long, conversation_id string")

    def judge(text):
        assert "hi" not in text.split()
        return dict.fromkeys(gate.DIMENSIONS, 2 if " low" in text else 19)

    def model(text):
        if " broken" in text:
            raise RuntimeError("429")
        return {"title": "T", "summary": text[:10], "tags": ["A ", "a", "b"]}

    after, notes, tags = summarise.summarise_all(conversations, messages, have, judge, model, written)
    assert {r.id: (r.status, r.experience_gate_reason) for r in after.collect()} == {
        "good": ("summarized", None), "bad": ("filtered", "low-signal"), "low": ("filtered", "experience-threshold-not-met"), "broken": ("error", "429"), "done": ("imported", None), "old": ("summarized", None)}
    assert [(r.id, r.conversation_id, r.title) for r in notes.collect()] == [(8, "good", "T")] and sorted(r.tag for r in tags.collect()) == ["a", "b"]
    assert summarise.reset_errors(after).where("status = 'error'").count() == 0


def test_relation_candidates_fall_back_to_the_latest(spark):
    chunks = vectors.with_norm(spark.createDataFrame([(1, 0, "", [1.0, 0.0]), (2, 0, "", [0.5, 0.5])], "note_id long, chunk_index int, chunk_text string, vector array<float>"))
    notes = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02"), (3, "2026-01-03")], "id long, created_at string")
    titles = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert {tuple(r) for r in summarise.relation_candidates(notes, titles, chunks).collect()} == {(1, 2)}
    assert {tuple(r) for r in summarise.relation_candidates(notes, titles, chunks.where("note_id = 1"), 2).collect()} == {(1, 2), (1, 3)}
    waiting = spark.createDataFrame([(1, "pending"), (9, "pending")], "id long, embedding_status string")
    assert dict(summarise.after_embedding(waiting, chunks).collect()) == {1: "done", 9: "pending"}
    assert summarise.after_model_change(waiting, chunks)[1].count() == 0


def test_samples_and_their_report(spark, tmp_path):
    dims = dict.fromkeys(gate.DIMENSIONS, 18)
    message = lambda t, c: {"type": t, "content": c}
    samples = [
        {"id": "a", "label": "x", "expected_decision": "accept", "messages": [message("user", GOOD), message("assistant", "y"), message("user", "z")], "judge_dimensions": dims},
        {"id": "b", "label": "x", "expected_decision": "accept", "messages": [message("user", "ok")]}, {"id": "c", "label": "x", "expected_decision": "reject", "messages": [message("user", "好的")]},
    ]
    for name, content in (("list.json", samples), ("object.json", {"schema_version": 1, "samples": samples})):
        (tmp_path / name).write_text(json.dumps(content, indent=1))
        report = gate.evaluation(gate.evaluate(gate.load_samples(spark, f"{tmp_path}/{name}"))).first()
        assert (report.total, report.passed, report.failed, report.false_accepts, report.false_rejects) == (3, 2, 1, 0, 1)


def test_config_and_seed(spark, tmp_path):
    path = str(tmp_path / "config.json")
    assert Config.load(path) == Config()
    Config(enabled_sources=("codex",), known_sources=("codex", "trae"), embedder_options={"api_key": "s", "size": 8}).save(path)
    got = Config.load(path)
    assert "trae" not in got.enabled_sources and {"codex", "cursor"} <= set(got.enabled_sources)
    assert got.shown()["embedder_options"] == {"size": 8, "has_api_key": True}
    store = Store(spark, f"file://{tmp_path}/s")
    (tmp_path / "seed.json").write_text(json.dumps({"conversations": [{"id": "demo-1", "source": "codex"}], "notes": [{"id": 1, "title": "n", "key_conclusions": ["k"]}]}))
    assert seed(spark, store, f"{tmp_path}/seed.json") and not seed(spark, store, f"{tmp_path}/seed.json")
    assert store.read("notes").first().key_conclusions == ["k"]
    rows = memory.origin_conversations(store.read("conversations"), spark.createDataFrame([("o", "p")], "origin_id string, project_name string"), "written")
    assert sorted(r.id for r in rows.collect()) == ["demo-1", "memory:o"]
    assert got.enabled(store.read("conversations").withColumn("source", F.lit("trae"))).count() == 0
