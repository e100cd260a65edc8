"""Batches of writebacks against the same requests written one at a time."""

import random

import pytest

from talus.operators import memory
from tests.test_operators import MEMORY, RECEIPT

ASKED = "candidate_id long, mode string, source_agent string, source_run_key string, project_key string, scope string, source_type string, title string, summary string, outcome_type string, " \
    "root_cause string, resolution string, tags array<string>, " + ", ".join(f"{a} array<string>" for a in memory.ARRAYS)


def one_at_a_time(requests, stored, near=None):
    """(answers, signatures by memory): the rules, a request at a time; new memories are named after their request."""
    norm = lambda x: (x or "").strip().lower()
    known = {("old", n): (p, norm(c), norm(f), set(s)) for n, p, c, f, s in stored}
    order, answers = sorted(known), {}
    for i, p, c, f, signs, summary in sorted(requests):
        if len(summary) < 24 or not (norm(c) or norm(f) or signs):
            answers[i] = ("skipped", None)
            continue
        pool = order if near is None else [("old", n) for n in near.get(i, [])] + [m for m in order if m[0] == "new"]
        hit = next((m for m in pool if p and norm(c) and known[m][:3] == (p, norm(c), norm(f)) and known[m][3] & set(signs)), None)
        if hit:
            known[hit][3].update(signs)
            answers[i] = ("merged", hit)
        else:
            known["new", i] = (p, norm(c), norm(f), set(signs))
            order.append(("new", i))
            answers[i] = ("created", None)
    return answers, known


def some(seed, n=200, signs=14):
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["p", "q", None, ""]) if rng.random() < 0.1 else "p", rng.choice(["why", " WHY ", "other", None]), rng.choice(["fix", "Fix ", "", None]))
    about = lambda: [f"E{rng.randrange(signs)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    stored = [(k, *pick(), about()) for k in range(1, 12)]
    requests = [(1000 + 3 * k, *pick(), about(), "short" if rng.random() < 0.05 else f"a summary that is long enough {k}") for k in range(n)]
    return requests, stored


def frames(spark, requests, stored):
    empty = {a: [] for a in memory.ARRAYS}
    asked = [(i, "auto", "codex", f"run{i}", p, "project", "agent-writeback", "t", text, "fix", c, f, [], *(signs if a == "error_signatures" else [] for a in empty)) for i, p, c, f, signs, text in requests]
    have = {"title": "t", "summary": "s", "outcome_type": "fix", "tags": [], "scope": "project"}
    names = [x.split()[0] for x in MEMORY.split(", ")]
    old = [tuple({**empty, **have, "note_id": n, "project_key": p, "root_cause": c, "resolution": f, "error_signatures": s}.get(name) for name in names) for n, p, c, f, s in stored]
    return spark.createDataFrame(asked, ASKED), spark.createDataFrame(old, MEMORY)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_decides_as_one_at_a_time(spark, seed):
    requests, stored = some(seed)
    asked, old = frames(spark, requests, stored)
    got = {r.candidate_id: r for r in memory.decide_batch(asked, old.withColumn("rank", old.note_id)).collect()}
    want, _ = one_at_a_time(requests, stored)
    into = lambda r: ("old", r.target_note_id) if r.target_note_id else ("new", r.target_candidate_id) if r.target_candidate_id else None
    assert {i: (r.decision, into(r)) for i, r in got.items()} == want
    assert {"old", "new"} <= {w[1][0] for w in want.values() if w[1]}


def test_a_chain_of_signatures_ends_in_few_rounds(spark, monkeypatch):
    """Each request shares a signature with the one before only: all are merged into the first."""
    requests = [(k, "p", "why", "fix", [f"E{k}", f"E{k + 1}"], "a summary that is long enough") for k in range(64)]
    asked, old = frames(spark, requests, [(500, "q", "why", "fix", ["E1"])])
    tables = []
    monkeypatch.setattr(memory, "written", lambda df, name, real=memory.written: tables.append(name) or real(df, name))
    got = memory.decide_batch(asked, old.withColumn("rank", old.note_id)).collect()
    assert {r.candidate_id: r.target_candidate_id for r in got} == {k: 0 if k else None for k in range(64)}
    assert tables.count("step") <= 9


def test_with_what_a_search_found(spark):
    requests, stored = some(3, 120)
    rng = random.Random(4)
    near = {r[0]: rng.sample([s[0] for s in stored], 4) for r in requests}
    asked, old = frames(spark, requests, stored)
    found = spark.createDataFrame([(i, n, k) for i, ns in near.items() for k, n in enumerate(ns)], "candidate_id long, note_id long, rank int")
    got = memory.decide_batch(asked, old, found).collect()
    want, _ = one_at_a_time(requests, stored, near)
    assert {r.candidate_id: (r.decision, ("old", r.target_note_id) if r.target_note_id else ("new", r.target_candidate_id) if r.target_candidate_id else None) for r in got} == want


def test_written_batch_holds_what_single_writes_would(spark):
    requests, stored = some(5, 60)
    requests = [r for r in requests if r[2] or (r[3] or "").strip()]
    asked, old = frames(spark, requests, stored)
    answers, memories, receipts = memory.write_memories(asked, old, spark.createDataFrame([], RECEIPT))
    got, kept = {r.candidate_id: r for r in answers.collect()}, {r.note_id: r for r in memories.collect()}
    want, known = one_at_a_time(requests, stored)
    number = {("new", i): got[i].note_id for i, (d, _) in want.items() if d == "created"} | {("old", n): n for n, *_ in stored}
    assert {i: (r.decision, r.merged_into_note_id) for i, r in got.items()} == {i: (d, number[t] if t else None) for i, (d, t) in want.items()}
    assert {n: set(r.error_signatures) for n, r in kept.items()} == {number[m]: k[3] for m, k in known.items()}
    assert sum(r.summary.count("Evidence update:") for r in kept.values()) == sum(d == "merged" for d, _ in want.values())
    assert receipts.count() == len(requests) and memory.write_memories(asked, memories, receipts)[1].count() == len(kept)
