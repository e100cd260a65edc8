"""Findings of the third review: one odd table each, on which the query left its SQL."""

import shutil

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from talus import catalog
from talus.operators import vectors
from talus.plans import imports
from talus.shared import local_path
from talus.sources import registry, tool_a, tool_d
from tests.oracle import same

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()

#: Signals in capitals outside ASCII, and letters that only look alike: conversation, turn, role, text.
SAID = [
    (1, 0, "user", "TION ÑAS ou ble thest " + "x" * 120), (2, 0, "user", "mentou oi ñas"), (3, 0, "user", "oK"), (3, 1, "user", "decıde İer cı"),
    (4, 0, "user", "tion ou LIſCH BLE neſs " + "y" * 900), (4, 1, "assistant", "erreur ASier"), (5, 0, "user", "TİON ıng ble"),
    (6, 0, "user", "TION ou ble thest ÑA " + "z" * 900), (6, 1, "user", "and again"),
]


@pytest.fixture(scope="module")
def said(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("said")
    spark.createDataFrame(SAID, "conv_id long, turn int, role string, text string").toPandas().to_parquet(folder / "conversations.parquet")
    spark.createDataFrame([(c, 1, int(c == 6)) for c in range(1, 7)], "doc_id long, quality int, toxic int").toPandas().to_parquet(folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["signals", "gate_prefilter", "gate_combine", "gate_eval_report"])
def test_signals_in_either_case_of_any_letter(spark, said, name):
    same(spark, QUERIES[name], ORACLE[name], said)


@pytest.fixture(scope="module")
def half_labelled(spark, tmp_path_factory):
    """Conversations that the gate would take, with a label whose toxicity or quality isn't known."""
    folder = tmp_path_factory.mktemp("half_labelled")
    said = [(c, n, "user", t) for c in range(1, 7) for n, t in enumerate(["tion ou erreur ing thest ness" + (" ble " if c % 2 else " ") + "x" * 900, "and again"])]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").toPandas().to_parquet(folder / "conversations.parquet")
    labels = [(1, 1, None), (2, 1, None), (3, None, 0), (4, None, None), (5, 1, 0), (6, 0, 1), (6, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas().astype("Int64").to_parquet(folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["gate_combine", "gate_eval_report"])
def test_what_is_not_judged_gives_no_points(spark, half_labelled, name):
    same(spark, QUERIES[name], ORACLE[name], half_labelled)


@pytest.fixture(scope="module")
def spaced(spark, tmp_path_factory):
    """Messages that are null, or have white space of which the SQL takes only some; without a decision, so that turns decide."""
    folder = tmp_path_factory.mktemp("spaced")
    long = "tion thest ing ble " + "x" * 900
    second = [None, "", " ok ", "\tok", "ok\n", "\u00a0OK\u3000", "\u2028ok", "ok\x0b", "\ufeffthe.", "\u0085ok", "the.\r\n"]
    said = [(c, 0, "user", long) for c in range(len(second))] + [(c, 1, "user", t) for c, t in enumerate(second)]
    said += [(20, 0, "user", "tion ble ez " + "x\u00a0" * 395), (21, 0, "user", "tion ble ez " + "x\t\n " * 790), (22, 0, "user", None), (23, 0, None, long)]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").toPandas().to_parquet(folder / "conversations.parquet")
    spark.createDataFrame([(c, 1, 0) for c in range(24)], "doc_id long, quality int, toxic int").toPandas().to_parquet(folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["effective_turns", "signals", "gate_prefilter", "gate_combine", "gate_eval_report"])
def test_null_messages_and_white_space_are_those_of_the_sql(spark, spaced, name):
    same(spark, QUERIES[name], ORACLE[name], spaced)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Lines of an order that share a number, the later ones in a larger file, which Spark reads first."""
    folder = tmp_path_factory.mktemp("lines")
    columns = "l_orderkey long, l_linenumber int, l_extendedprice double"
    (folder / "lineitem.parquet").mkdir()
    spark.createDataFrame([(k, n, 10.0 * k + n) for k in (3, 5, 6, 7) for n in (1, 2)], columns).toPandas().to_parquet(folder / "lineitem.parquet" / "part-0.parquet")
    later = [(k, n, -float(10 * k + n)) for k in (3, 5, 6, 7, *range(1001, 3001)) for n in (2, 1)]
    spark.createDataFrame(later, columns).toPandas().to_parquet(folder / "lineitem.parquet" / "part-1.parquet")
    spark.createDataFrame([(3, 0.5), (6, 0.5), (8, 0.5)], "o_orderkey long, o_totalprice double").toPandas().to_parquet(folder / "orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name, want", [
    ("upsert_last_wins", {3: 32.0, 6: 62.0, 8: 0.5}), ("insert_ignore", {3: 31.0, 5: 51.0, 6: 0.5, 7: 71.0, 8: 0.5}),
])
def test_of_lines_with_one_number_the_first_of_the_table_wins(spark, lines, name, want):
    assert dict(QUERIES[name](spark, lines).where("o_orderkey < 10").collect()) == want


@pytest.mark.parametrize("name", ["upsert_last_wins", "insert_ignore"])
def test_lines_without_a_price_or_number_give_way(spark, tmp_path, name):
    lines = [(3, 1, 10.0), (3, 2, None), (6, None, 5.0), (6, None, 6.0), (9, 1, 7.0), (9, None, 8.0), (12, 1, None), (15, 2, 1.0), (15, 2, 2.0), (15, 1, None), (None, 1, 1.0), (-3, 2, 4.0), (-3, 1, None)]
    schema = "l_orderkey long, l_linenumber int, l_extendedprice double"
    pq.write_table(spark.createDataFrame(lines, schema).coalesce(1).toArrow(), tmp_path / "lineitem.parquet")
    pq.write_table(spark.createDataFrame([(3, 0.5), (6, 0.5), (7, 0.5), (8, None), (None, 0.5)], "o_orderkey long, o_totalprice double").toArrow(), tmp_path / "orders.parquet")
    same(spark, QUERIES[name], ORACLE[name], str(tmp_path))


def test_a_query_goes_to_a_bundle_of_lists_once_and_finds_what_its_lists_hold(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 150)
    monkeypatch.setattr(vectors, "HELD", 10)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 8)).astype(np.float32)
    points[100:400] = points[100]  # a list of two pieces that are copies
    store = spark.createDataFrame([(n, 0, "", [float(x) for x in v]) for n, v in enumerate(points)], "note_id long, chunk_index int, chunk_text string, vector array<float>")
    asked = store.where("note_id % 10 = 0").select(F.col("note_id").alias("query_id"), "vector")
    index = vectors.VectorIndex.build(store, lists=20)
    sizes = [tuple(r) for r in index.sizes.select("_list", "_bundle", "_pieces").collect()]
    groups = len({(b, p) for _, b, n in sizes for p in range(n)})
    assert groups < len(sizes) and vectors._dealt(asked, index.centres, 20, sizes).count() == 60 * groups
    at = dict(index.chunks.select("note_id", "_list").collect())
    near = np.argsort(-(vectors.unit(points[::10].astype(float)) @ index.centres.T), axis=1, kind="stable")
    scores = vectors.unit(points[::10].astype(float)) @ vectors.unit(points.astype(float)).T
    for probes in (3, 20):
        got = {}
        for r in index.search(asked, 5, probes=probes).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.note_id, r.score))
        for q in range(60):
            there = [n for n in range(600) if at[n] in near[q, :probes]]
            best = sorted((scores[q, there]).tolist(), reverse=True)[:5]
            assert np.allclose([s for _, _, s in sorted(got[q * 10])], best) and {n for _, n, _ in got[q * 10]} <= set(there)


@pytest.mark.parametrize("source", [tool_a.SOURCE, tool_d.SOURCE])
def test_session_files_are_read_once_for_both_results(spark, source):
    places = imports._places(spark, "/root/testdata/sf0.001", source)
    conversations, messages = registry.parse_all(spark, registry.scan_all(spark, places).cache(), places)
    shutil.rmtree(local_path(next(iter(places[source].values()))))
    said = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert messages.count() == said.count()
    assert conversations.agg(F.sum("message_count")).first()[0] == said.count()
