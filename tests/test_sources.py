import json
import sqlite3

import pytest

from talus.sources import registry, tool_a, tool_b, tool_c, tool_d, tool_e
from talus.store import Store
from talus.streaming.ingest import import_changes, stream_new_files, watch


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"


def said(uuid, kind, content, at, **more):
    return {"uuid": uuid, "type": kind, "timestamp": f"2026-01-01T00:00:{at:02}.000Z", "message": {"role": kind, "content": content}, **more}


@pytest.fixture
def places(tmp_path):
    a = tmp_path / "a" / "c--Users-Jo-Projects-Shop-Admin"
    a.mkdir(parents=True)
    (a / "s1.jsonl").write_text(lines(
        "{broken", {"type": "user", "message": {"content": "no uuid"}}, said("0", "system", "x", 0), said("1", "progress", "x", 0),
        said("u1", "user", "hi <system-reminder>a\nb</system-reminder><command-name>/x</command-name> there", 5, cwd="", slug="first"), said("u2", "user", "second", 9, cwd="/w", slug="later"),
        said("a1", "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "see\n```py"}, {"type": "tool_use", "id": "t"}, {"type": "text", "text": "<command-args>z</command-args>end"}], 5),
        said("a2", "assistant", [{"type": "tool_use"}], 10), said("a3", "assistant", "  ", 11),
    ))
    (a / "tiny.jsonl").write_text("{}")
    b = tmp_path / "b" / "2026" / "01"
    b.mkdir(parents=True)
    ev = lambda n, kind, **p: {"timestamp": f"2026-01-02T00:00:{n:02}.000Z", "type": kind, "payload": p}
    (b / "rollout-2026-01-02T10-11-12-abc.jsonl").write_text(lines(
        ev(0, "session_meta", id="own-id", cwd="/home/jo/shop", git={"branch": "main"}), ev(1, "response_item", type="function_call"),
        ev(2, "event_msg", type="user_message", message="noise ## My request for Codex:\n do it "), ev(3, "event_msg", type="agent_message", message="done it"),
        ev(4, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "done it"}]), ev(5, "response_item", type="function_call"),
        ev(6, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "more"}]), ev(7, "response_item", type="message", role="user", content=[{"type": "output_text", "text": "skip"}]), "oops",
    ))
    index = tmp_path / "session_index.jsonl"
    index.write_text(lines({"id": "own-id", "thread_name": "old"}, {"id": "own-id", "thread_name": "new name"}))
    for tool in ("c", "d", "e"):
        for ws in ("w1",):
            (tmp_path / tool / ws).mkdir(parents=True)
            (tmp_path / tool / ws / "workspace.json").write_text(json.dumps({"folder": "file:///home/jo/my%20shop+1"}))

    def kv(path, table, rows):
        with sqlite3.connect(path) as db:
            db.execute(f"create table {table} (key text, value blob)")
            db.executemany(f"insert into {table} values (?, ?)", rows)
        db.close()

    kv(tmp_path / "c" / "w1" / "state.vscdb", "ItemTable", [("composer.composerData", json.dumps({"allComposers": [{"composerId": "k1", "createdAt": 1}]})), ("other", "1")])
    bubble = lambda n, **b: json.dumps({"createdAt": f"2026-01-03T00:00:{n:02}.000Z", **b})
    kv(tmp_path / "global.vscdb", "cursorDiskKV", [
        ("bubbleId:k1:b2", bubble(2, type=2, text="answer", toolResults=[{"a": 1}], allThinkingBlocks=[{"thinking": "x"}, {"text": "y"}])), ("bubbleId:k1:b1", bubble(1, type=1, text=" ask ", bubbleId="own")),
        ("bubbleId:k1:b3", bubble(3, type=2, text="")), ("bubbleId:lost:b1", bubble(1, type=1, text="orphan")), ("bubbleId:mute:b1", bubble(1, type=2, text=" ")), ("bubbleIdX", "{}"), ("bubbleId:k1:bad", "{"),
    ])
    session = {"sessionId": "t1", "createdAt": 1000, "updatedAt": 2, "messages": [
        {"role": "user", "content": "q", "turnIndex": 0, "timestamp": 5000}, {"role": "system", "content": "s", "turnIndex": 0},
        {"role": "assistant", "content": " ", "turnIndex": 1, "timestamp": 3000, "agentMessageId": "m", "agentTaskContent": {"proposal": "plan", "proposalReasoningContent": "r0", "guideline": {
            "thought": "unused", "planItems": [{"toolName": "edit", "thought": "no", "reasoningContent": "r1"}, {"toolName": "finish", "thought": "summary"}]}}},
        {"role": "assistant", "content": "", "turnIndex": 2, "agentTaskContent": {"guideline": {"thought": "only"}}},
    ]}
    kv(tmp_path / "d" / "w1" / "state.vscdb", "ItemTable", [(tool_d.KEY, json.dumps({"list": [session, {"sessionId": "empty", "messages": []}]}).encode())])
    chats = tmp_path / "e" / "w1" / "chatSessions"
    chats.mkdir()
    ask = {"requestId": "r1", "timestamp": 1_700_000_000_000, "message": {"text": " hello "}, "response": [{"value": "one"}, {"kind": "thinking", "value": "deep"}, {"kind": "text", "value": "two ```"}, {"kind": "toolInvocationSerialized"}]}
    quiet = {"requestId": "r2", "timestamp": 1_700_000_001_000, "message": {"text": "again"}, "response": []}
    (chats / "f1.jsonl").write_text(lines({"kind": 0, "v": {"sessionId": "e1", "creationDate": 1, "customTitle": "title", "requests": [ask, quiet]}}, {"kind": 1, "v": {}}))
    (chats / "f2.json").write_text(json.dumps({"sessionId": "e2", "requests": [ask, quiet]}, indent=1))
    (chats / "f3.jsonl").write_text(lines({"kind": 1, "k": ["x"] * 40, "v": {"requests": []}}))
    return {
        tool_a.SOURCE: {"root": str(tmp_path / "a")}, tool_b.SOURCE: {"root": str(tmp_path / "b"), "index_file": str(index)},
        tool_c.SOURCE: {"workspaces": str(tmp_path / "c"), "global_file": str(tmp_path / "global.vscdb")}, tool_d.SOURCE: {"workspaces": str(tmp_path / "d")},
        tool_e.SOURCE: {"workspaces": str(tmp_path / "e")},
    }


@pytest.fixture
def parsed(spark, places):
    metas = registry.scan_all(spark, places)
    conversations, messages = registry.parse_all(spark, metas, places)
    by = {}
    for m in messages.orderBy("conversation_id", "sort_order").collect():
        by.setdefault(m.conversation_id, []).append(m)
    return {c.id: c for c in conversations.collect()}, by


def test_all_sources(spark, places, parsed):
    conversations, messages = parsed
    assert dict(registry.descriptors(registry.scan_all(spark, places)).collect()) == {"claude-code": 1, "codex": 1, "cursor": 2, "trae": 1, "copilot": 3}
    assert set(conversations) == {"s1", "own-id", "k1", "lost", "t1", "e1", "e2", "f3"}

    a = conversations["s1"]
    assert (a.project_name, a.slug, a.cwd, a.message_count) == ("Shop-Admin", "first", "/w", 4)
    assert [(m.id, m.content, m.has_tool_use, m.has_code, m.thinking) for m in messages["s1"]] == [
        ("u1", "hi  there", False, False, None), ("a1", "see\n```py\nend", True, True, "hm"), ("u2", "second", False, False, None), ("a2", "", True, False, None)]

    b = conversations["own-id"]
    assert (b.project_name, b.git_branch, b.slug, b.cwd) == ("shop", "main", "new name", "/home/jo/shop")
    assert [(m.type, m.content, m.has_tool_use) for m in messages["own-id"]] == [("user", "do it", False), ("assistant", "done it", True), ("assistant", "more", False)]

    assert conversations["k1"].project_name == "my shop+1" and conversations["lost"].project_dir == ""
    assert [(m.id, m.type, m.content, m.has_tool_use, m.thinking) for m in messages["k1"]] == [("own", "user", "ask", False, None), ("b2", "assistant", "answer", True, "x\ny")]

    assert [(m.content, m.thinking, m.has_tool_use, m.timestamp[17:]) for m in messages["t1"]] == [
        ("q", None, False, "05.000Z"), ("plan\n\nsummary", "r0\nr1", True, "05.001Z"), ("only", None, False, "05.002Z")]

    assert conversations["e1"].slug == "title" and conversations["f3"].message_count == 0
    for e in ("e1", "e2"):
        assert [(m.id, m.content, m.thinking, m.has_tool_use, m.has_code) for m in messages[e]] == [
            ("r1", "hello", None, False, False), ("resp-r1", "one\ntwo ```", "deep", True, True), ("r2", "again", None, False, False)]


def test_incremental_import(spark, places, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    only = {tool_a.SOURCE: places[tool_a.SOURCE], tool_e.SOURCE: places[tool_e.SOURCE]}
    assert import_changes(spark, store, only) == {"imported": 3, "skipped": 1, "unchanged": 0}
    assert import_changes(spark, store, only) == {"imported": 0, "skipped": 0, "unchanged": 4}
    log = tmp_path / "a" / "c--Users-Jo-Projects-Shop-Admin" / "s1.jsonl"
    log.write_text(log.read_text() + lines(said("u9", "user", "one more", 59)))
    seen = []
    watch(spark, store, only, every=0, rounds=2, report=seen.append)
    assert [s["imported"] for s in seen] == [1, 0]
    assert store.read("messages").where("conversation_id = 's1'").count() == 5 and store.read("conversations").count() == 3
    parts = store._manifest().versions["conversations"]
    assert len(parts) > 1 and len(set(parts.values())) == 2  # the third import wrote the part of s1 alone
    before = sorted(map(tuple, store.read("messages").collect()))
    assert store.vacuum() == 0 or sorted(map(tuple, store.read("messages").collect())) == before


def test_new_files_as_a_stream(spark, places, tmp_path):
    got = []
    query = stream_new_files(spark, places[tool_a.SOURCE]["root"], "*.jsonl", lambda df, n: got.append((n, df.count())), str(tmp_path / "checkpoint"), every="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert sum(n for _, n in got) == 2


def test_unreadable_key_value_files_are_named(spark, places, tmp_path):
    from talus.sources import key_values

    (tmp_path / "d" / "w1" / "sub").mkdir()
    (tmp_path / "d" / "w1" / "sub" / "state.vscdb").write_text("not a database")
    root = places[tool_d.SOURCE]["workspaces"]
    assert key_values.read(spark, root, tool_d.STATE_FILE, "ItemTable").count() == 1
    assert [r.file_path.rsplit("/", 2)[1] for r in key_values.unreadable(spark, root, tool_d.STATE_FILE, "ItemTable").collect()] == ["sub"]
    assert tool_d.scan(spark, root).count() == 1


def test_project_keys_of_checkouts(spark, tmp_path):
    from talus.operators.memory import short_digest
    from talus.sources.checkouts import checkouts, with_project_keys
    from pyspark.sql import functions as F

    for name, text in (("shop", '[core]\n\tbare = false\n[remote "fork"]\n\turl = https://x.org/o/fork\n[remote "origin"]\n\turl = git@x.org:O/Shop.git\n\tfetch = +refs\n'), ("shop/inner", "[core]\n")):
        (tmp_path / name / ".git").mkdir(parents=True)
        (tmp_path / name / ".git" / "config").write_text(text)
    known = checkouts(spark, str(tmp_path))
    assert {r.git_root.removeprefix(f"{tmp_path}/"): [tuple(x) for x in r.remotes] for r in known.collect()} == {
        "shop": [("fork", "https://x.org/o/fork"), ("origin", "git@x.org:O/Shop.git")], "shop/inner": []}
    rows = spark.createDataFrame([(1, f"{tmp_path}/shop/src/a"), (2, f"{tmp_path}/shop/inner"), (3, "/elsewhere"), (4, None)], "id int, cwd string")
    keys = spark.range(1).select(short_digest(F.lit("x.org/o/shop")).alias("a"), short_digest(F.lit(f"{tmp_path}/shop/inner")).alias("b"), short_digest(F.lit("/elsewhere")).alias("c")).first()
    assert dict(with_project_keys(rows, known).select("id", "project_key").collect()) == {1: f"git:{keys.a}", 2: f"path:{keys.b}", 3: f"cwd:{keys.c}", 4: None}


def test_a_large_key_value_file_is_read_by_ranges(spark, tmp_path):
    """Also one whose journal is a log beside it: what the log holds is not seen."""
    from pyspark.sql import functions as F
    from talus.sources import key_values

    path = tmp_path / "has space+%41" / "state.vscdb"
    path.parent.mkdir()
    with sqlite3.connect(path) as db:
        db.execute("pragma journal_mode=wal")
        db.execute("create table cursorDiskKV (key text unique, value blob)")
        db.executemany("insert into cursorDiskKV values (?, ?)", ((f"{'bubbleId' if k % 2 else 'other'}:{k:06}", None if k == 1 else f"v{k}" * 9) for k in range(70_000)))
        db.commit()
        db.execute("pragma wal_checkpoint(truncate)")
        db.execute("insert into cursorDiskKV values ('bubbleId:late', 'x')")
        db.commit()
        rows = key_values.read(spark, str(tmp_path), "*.vscdb", "cursorDiskKV", "bubbleId:").withColumn("task", F.spark_partition_id()).collect()
    assert {(r.key, r.value) for r in rows} == {(f"bubbleId:{k:06}", None if k == 1 else f"v{k}" * 9) for k in range(1, 70_000, 2)} and len(rows) == 35_000
    assert len({r.task for r in rows}) > 1
    db.close()


def test_lines_come_from_tasks_in_blocks(spark, tmp_path):
    """Line numbers go on over blocks, and no path goes through the driver."""
    from talus.sources import common

    long = "x" * 100_000
    (tmp_path / "a b+%41").mkdir()
    (tmp_path / "a b+%41" / "big.jsonl").write_bytes(b"\r\n".join([b"first", b"", *([long.encode()] * 100), b"  ", "läst".encode()]))
    (tmp_path / "empty.jsonl").write_text("")
    metas = common.files(spark, str(tmp_path), "*.jsonl")
    got = {r.line_no: r.line for r in common.file_lines(spark, metas).collect()}
    assert got == {0: "first", **dict.fromkeys(range(2, 102), long), 103: "läst"}
    # What only Spark opens gives the same.
    assert {r.line_no: r.line for r in common.lines(common._by_spark(spark, metas)).collect()} == got
    texts = {r.file_path.rsplit("/", 1)[1]: len(r.text) for r in common.whole_texts(spark, metas).collect()}
    assert texts == {"big.jsonl": 10_000_000 + 5 + 2 + 4 + 2 * 103}  # Spark lists no empty files
