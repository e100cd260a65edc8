"""Top k of many queries: exact by bounded heaps, and by an index of lists with its recall measured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import summarise, vectors
from talus.plans.views import chunks as chunks_of

SF = "/root/testdata/sf0.1"


def brute(queries, points, k):
    """Place of the k nearest points of each query, ties by place."""
    scores = vectors.unit(queries) @ vectors.unit(points).T
    return [sorted(range(len(points)), key=lambda c: (-scores[q, c], c))[:k] for q in range(len(queries))]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_hits_over_many_batches_with_ties(k):
    rng = np.random.default_rng(k)
    points = rng.integers(-1, 2, (300, 3)).astype(float)  # few directions, so most scores tie
    queries = rng.integers(-2, 3, (17, 3)).astype(float)
    best = vectors.BestHits(queries, k)
    for at in range(0, 300, 23):
        best.add(points[at : at + 23], np.arange(at, min(300, at + 23)) // 2, np.arange(at, min(300, at + 23)) % 2)
    q, score, note, place = best.rows
    got = [(note[q == n] * 2 + place[q == n]).tolist() for n in range(17)]
    assert [len(g) for g in got] == [k] * 17
    true = vectors.unit(queries) @ vectors.unit(points).T
    for n, g in enumerate(got):  # sums of a matrix product may differ in the last place between batches
        assert np.allclose(np.sort(true[n, g])[::-1], np.sort(true[n])[::-1][:k])
    assert np.allclose(score, true[q, note * 2 + place])


@pytest.fixture(scope="module")
def stored(spark):
    return chunks_of(spark, SF).cache()


@pytest.fixture(scope="module")
def titles(stored):
    return stored.where("chunk_index = 0 and note_id % 10 = 0").select(F.col("note_id").alias("query_id"), "vector").cache()


def found(df):
    return {(r.query_id, r.note_id, r.chunk_index) for r in df.collect()}


def test_recall_of_the_index_is_nine_tenths_and_its_work_less(spark, stored, titles):
    exact = found(vectors.top_chunks_of_many(stored, titles, 10))
    index = vectors.VectorIndex.build(stored)
    assert index.chunks.count() == stored.count() and 1 <= index.probes < 0.75 * len(index.centres)
    near = found(index.search(titles, 10))
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)
    assert found(index.search(titles, 10, probes=len(index.centres))) == exact


def test_few_lists_are_looked_at_where_vectors_lie_in_clusters(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 16))
    points = [(k, 0, "", [float(x) for x in middles[k % 20] + 0.05 * rng.normal(size=16)]) for k in range(1200)]
    store = spark.createDataFrame(points, "note_id long, chunk_index int, chunk_text string, vector array<float>").cache()
    asked = store.where("note_id < 100").select(F.col("note_id").alias("query_id"), "vector")
    index = vectors.VectorIndex.build(store)
    exact, near = found(vectors.top_chunks_of_many(store, asked, 10)), found(index.search(asked, 10))
    assert len(near & exact) >= 0.9 * len(exact) and index.probes <= len(index.centres) / 4


def test_lists_of_any_size_are_cut_into_pieces(spark, stored, titles, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 37)
    index = vectors.VectorIndex.build(stored, lists=3)
    assert index.sizes.agg(F.max("_pieces")).first()[0] > 5
    assert found(index.search(titles, 7, probes=3)) == found(vectors.top_chunks_of_many(stored, titles, 7))


def test_odd_vectors(spark):
    rows = [(1, 0, "", [0.0, 0.0]), (2, 0, "", [1.0, 0.0]), (2, 0, "", [1.0, 0.0]), (3, 0, "", None), (4, 0, "", [0.0, 2.0])]
    store = vectors.with_norm(spark.createDataFrame(rows, "note_id long, chunk_index int, chunk_text string, vector array<float>"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<float>")
    got = vectors.VectorIndex.build(store, lists=2).search(asked, 2, probes=2)
    assert sorted((r.query_id, r["rank"], r.note_id) for r in got.collect()) == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    none = vectors.VectorIndex.build(store.where("false"))
    assert none.search(asked, 2).count() == 0 and vectors.VectorIndex.build(store).search(asked.where("false"), 2).count() == 0


def test_relation_candidates_by_the_index(spark, stored, titles):
    notes = stored.select(F.col("note_id").alias("id")).distinct().withColumn("created_at", F.lit("2026"))
    exact = {tuple(r) for r in summarise.relation_candidates(notes, titles, stored, 10).collect()}
    near = {tuple(r) for r in summarise.relation_candidates(notes, titles, stored, 10, vectors.VectorIndex.build(stored)).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_recall_of_many_is_one_recall_each(spark):
    """Every task's memories and reason are those of a call of its own, tasks without a key, and without any match, included."""
    from talus.operators import memory
    from talus.plans.views import relations, vector_notes
    from tests.oracle import plain

    small = "/root/testdata/sf0.001"
    chunks, known = chunks_of(spark, small).cache(), vector_notes(spark, small).withColumn("title", F.lit("a title")).cache()
    about = known.select(
        F.col("id").alias("note_id"), F.when(F.col("id") % 3 == 0, "").otherwise("own").alias("title"), F.lit(" ").alias("summary"), F.concat(F.lit("k"), F.col("id") % 3).alias("project_key"),
        F.when(F.col("id") % 5 == 0, "global").alias("scope"), F.lit("fix").alias("outcome_type"), *(F.lit(None).cast("array<string>").alias(c) for c in ("pitfalls", "reusable_patterns")),
    ).where("note_id % 4 <> 1").cache()
    edges = relations(spark, small).cache()
    aliases = spark.createDataFrame([("k2", "k1"), ("k9", "k0")], "alias_key string, canonical_key string")
    vector = {r.note_id: list(r.vector) for r in chunks.where("chunk_index = 1").collect()}
    asked = [(n, vector[n], key) for n, key in zip(sorted(vector)[:6], ("k0", "k1", "k2", "k9", None, "  "), strict=True)] + [(99, None, "k1")]
    memories, reasons = memory.recall_many(spark.createDataFrame(asked, "query_id long, vector array<double>, project_key string"), chunks, known, about, edges, aliases, 4, 2)
    want = {}
    for n, x, key in asked:
        want[n] = "no-matches" if (key or "").strip() else "no-project-key"
        if x is None:
            continue
        k = min(memory.recall_size(4, 2), vectors.MOST_HITS)
        found = vectors.expand(vectors.direct_hits(vectors.top_chunks(chunks, x, k), known), edges, known).withColumn("title", F.lit("a title"))
        hits = spark.createDataFrame([(*r, at) for at, r in enumerate(found.collect())], "note_id long, chunk_text string, score double, via_relation string, title string, rank int")
        canonical = {"k2": "k1", "k9": "k0"}.get(key, key)
        keys = memory.key_set(aliases, canonical) if want[n] == "no-matches" else aliases.where("false").select(F.col("alias_key").alias("project_key"))
        one = memory.recall(hits, about, edges, keys, 4, 2).collect()
        got = memories.where(F.col("query_id") == n).drop("query_id").collect()
        assert sorted(repr(plain(tuple(r))) for r in got) == sorted(repr(plain(tuple(r))) for r in one) and one
        assert all(r.position <= (4 if r.bucket == "project" else 2) for r in one)
        want[n] = memory.recall_reason(memories.where(F.col("query_id") == n), (key or "").strip() or None)
    assert dict(reasons.collect()) == want and set(want.values()) == {"ok", "no-matches", "no-project-key"}
