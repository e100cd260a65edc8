"""Lexical search, streaming dedup and the audit of sources: brute force, edges, and what their methods promise."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import divergence, search, stream_dedup
from talus.llm.common import new_path
from tests.llm.test_edges import ODD, none, odd  # noqa: F401

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(ASCII))


def ranked(docs, items, k):
    """The contract, one document and item at a time."""
    said = [(d, words(t, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) for d, t in docs]
    n_docs, length = sum(bool(w) for _, w in said), sum(len(w) for _, w in said)
    df = Counter(t for _, w in said for t in set(w))
    out = []
    for item, text in items:
        asked, scores = set(words(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), []
        for d, w in said:
            tf = Counter(w)
            m = 100 - 90 + (90 * len(w) * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_search_of_odd_texts(spark, odd, none):  # noqa: F811
    items = [(1, "A b, c"), (2, None), (3, "..."), (None, "an id WITHOUT"), (1, "é w"), (4, "nowhere")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = ranked([(d, t) for d, t, _, _ in ODD], items, 2)
    assert got(search.search(odd, asked, k=2), "item_id", "rank", "doc_id", "score") == want
    assert search.search(none, asked).count() == 0 and search.search(odd, asked.where("false")).count() == 0


def test_search_in_several_blocks_of_queries_and_documents(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()], 7)
    monkeypatch.setattr(search, "QUERY_CHARS", 2000)
    assert got(search.search(docs, items, k=7), "item_id", "rank", "doc_id", "score") == want


def block_of(rng, docs, terms, pairs):
    """A block of random lists, and all its impacts."""
    has = rng.random((terms, docs)) < rng.uniform(0.01, 0.6, terms)[:, None]
    impact = np.where(has, rng.integers(1, 1000, (terms, docs)), 0)
    names = [t for t in range(terms) if has[t].any()]
    places = [np.flatnonzero(has[t]) for t in names]
    both = [np.flatnonzero(has[a] & has[b]) for a, b in pairs]
    found = [p for p, at in enumerate(both) if len(at)]
    ends = lambda lists: np.cumsum([0, *map(len, lists)])
    joint = np.array([(impact[pairs[p][0]] + impact[pairs[p][1]])[both[p]].max() for p in found])
    together = np.concatenate([both[p] for p in found]) if found else np.zeros(0, int)
    made = search.Block(np.arange(docs), names, ends(places), np.concatenate(places), np.concatenate([impact[t][at] for t, at in zip(names, places)]), found, ends([both[p] for p in found]), together, joint)
    return made, impact


def test_pair_bounds_skip_more_and_lose_nothing():
    rng, skipped, without_pairs = np.random.default_rng(5), 0, 0
    for _ in range(200):
        units = [(0, 1), (2, 3), (4, 5), (6,)]
        number = {u: k for k, u in enumerate(units) if len(u) == 2}
        block, impact = block_of(rng, 200, 7, list(number))
        total = impact.sum(axis=0)
        least = int(np.sort(total)[-5])
        places = search.candidates(block, units, number, least)
        assert set(np.flatnonzero(total >= least)) <= set(places.tolist())
        assert (search.score(block, list(range(7)), places) == total[places]).all()
        skipped += 200 - len(places)
        alone = search.candidates(block, [(t,) for t in range(7)], {}, least)
        without_pairs += 200 - len(alone)
        assert search.candidates(block, units, number, int(impact.max(axis=1).sum()) + 1) is None
    assert skipped > without_pairs > 0


def test_a_floor_is_reached_by_k_documents(spark):
    docs = spark.createDataFrame([(i, "common " * (i % 5 + 1) + ("rare" if i < 4 else "") + f" own{i}") for i in range(60)], "doc_id long, text string")
    queries = search.Queries.of([(1, "common rare"), (2, "own7 common"), (3, "own7"), (4, "")])
    rows = search.forward(docs, queries)
    stats = search.Statistics.of(rows, len(queries.number))
    queries.pair(stats.weights)
    lowest = search.floors(search.build(rows, queries, stats), queries, 3)
    best = defaultdict(list)
    for item, _, _, score in ranked([tuple(r) for r in docs.collect()], [(1, "common rare"), (2, "own7 common"), (3, "own7")], 3):
        best[item].append(score)
    assert lowest[0] > 0 and lowest[0] <= min(best[1]) and lowest[1] <= min(best[2]) and lowest[2:] == [0, 0]


def held(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0))
    out = []
    for norm, own in groups.items():
        keep = min(own)
        for n, (_, z, d) in enumerate(sorted(own)):
            out.append((None if z else d, None if keep[1] else keep[2], len(own), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("digits", [64, 1, 0])
def test_stream_dedup_of_odd_texts_and_colliding_digests(spark, odd, none, digits):  # noqa: F811
    rows = [(d, t) for d, t, _, _ in ODD] + [(9, "A b c d e f"), (11, "a  b c d e f"), (10, "a\tb  cdef"), (12, "é😀\x00\x85")]
    path = new_path(spark, "dedup-in")
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "digest", "norm", "at", "size", "best", "part", "same", "_own")}).repartition(3).write.parquet(path)
    assert got(stream_dedup.dedup(spark, path, digits=digits), *COLUMNS) == held(rows)
    if digits == 64:
        nothing = new_path(spark, "dedup-none")
        none.write.parquet(nothing)
        assert stream_dedup.dedup(spark, nothing).count() == 0


def test_a_hot_group_is_dealt_out_and_whole(spark):
    rows = [(i, "the same text " + " " * (i % 3)) for i in range(3000)] + [(3000 + i, f"text {i}") for i in range(1000)]
    path = new_path(spark, "dedup-hot")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    assert got(stream_dedup.dedup(spark, path), *COLUMNS) == held(rows)


def test_state_stays_and_new_files_are_all_that_is_read(spark):
    """Three calls with one folder: a file a micro-batch, then more files, then none; the state is what all rows give."""
    path, folder = new_path(spark, "dedup-in"), new_path(spark, "dedup-state")
    first = [(i, f"text {i % 7}") for i in range(40)]
    second = [(100 + i, f"text  {i % 9} ") for i in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    frame(first).write.parquet(path)
    assert got(stream_dedup.dedup(spark, path, folder, files=1), *COLUMNS) == held(first)
    frame(second).write.mode("append").parquet(path)
    assert got(stream_dedup.dedup(spark, path, folder, files=2), *COLUMNS) == held(first + second)
    state = stream_dedup.ingest(spark, path, frame(first).schema, folder)
    assert state.agg(F.sum("size")).first()[0] == 70 and state.count() == 9
    located = spark.read.parquet(path).select("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    assert state.select("best.doc_id", "best.file", "best.row").join(located, ["doc_id", "file", "row"]).count() == 9


def audited(rows, least, k):
    said = [(lang or "", source or "", words(t, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")) for _, t, lang, source in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), sorted({(a, b) for a, b, _ in said})
    for lang, source, w in said:
        df[lang].update(set(w))
        count[lang, source].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in df[lang].items() if n >= least}
        sources = [s for a, s in groups if a == lang]
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        share = lambda c, own: {t: 1 + 1000000000 * (c[t] + 5) // (sum(own[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(count[lang, s], count[lang, s]) for s in sources}, share(whole, whole)
        for s in sources:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(far, 1)]
            lifted = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(lifted[:k], 1)]
    return sorted(out)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


def test_audit_of_odd_texts(odd, none):  # noqa: F811
    for least, k in ((1, 50), (1, 2), (2, 50), (100, 50)):
        assert got(divergence.audit(odd, least, k), *AUDIT) == sorted(audited(ODD, least, k), key=repr)
    assert divergence.audit(none).count() == 0


def test_audit_by_blocks_of_sources(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang <> 'en'")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    counts, groups = divergence.kept_counts(docs, 3)
    want = {r[:2] + (r[3],): r[4] for r in audited(rows, 3, 1) if r[2] == "pair"}
    found = {(r.lang, r.a, r.b): r.value for r in divergence.distances(counts, groups, block=3).collect()}
    assert found == {key: v for key, v in want.items() if key[1] < key[2]}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband_is_what_fewer_than_k_dominate(k):
    rng = np.random.default_rng(k)
    for n in (1, 40, 1500):
        count, lang = rng.integers(0, 30, n), rng.integers(0, 60, n)
        terms = [f"{x:06d}".encode() for x in rng.permutation(n)]
        place = np.argsort(np.argsort(terms))
        over = (count[:, None] >= count) & (lang[:, None] <= lang) & (place[:, None] < place)
        assert (divergence.skyband(count, lang, terms, k) == (over.sum(axis=0) < k)).all()


def test_shares_are_exact_for_counts_of_any_corpus(spark):
    rng = np.random.default_rng(1)
    count = rng.integers(0, 10**14, 50)
    n, v = count + rng.integers(0, 10**15 - 10**14, 50), 10**6
    want = [1 + 10**9 * (int(c) + 5) // (int(m) + 5 * v) for c, m in zip(count, n)]
    assert divergence.shares(count, n, v).tolist() == want
    rows = spark.createDataFrame([(int(c), int(m), v) for c, m in zip(count, n)], "c long, n long, v long")
    assert [r[0] for r in rows.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == want
