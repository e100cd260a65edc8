"""Each operator against brute force, or held-out data, on whole small tables."""

import base64
import collections
import hashlib
import html
import math
import pathlib
import random
import re
import textwrap
import time

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from talus.llm import chat, decontam, html_text, licenses, mixing, pii, quality, queries, simhash, substrings, token_counts
from talus.llm.common import new_path, table
from talus.llm.trie import close_pairs
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("budget", [1, 2, 5])
def test_trie_finds_all_close_pairs(budget):
    rng = np.random.default_rng(budget)
    centres = rng.integers(0, 1 << 63, size=(6, 2), dtype=np.uint64)
    keys = centres[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, 2), dtype=np.uint64)) * rng.integers(0, 2, (300, 2), dtype=np.uint64)
    keys = np.array(sorted(map(tuple, keys.tolist())), dtype=np.uint64)
    got = {(int(a), int(b)) for i, j, _ in close_pairs(keys, np.array([0]), 0, budget) for a, b in zip(i, j)}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if np.bitwise_count(keys[a] ^ keys[b]).sum() <= budget}
    assert got == want


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("most", [20_000, 3])
def test_simhash(docs, rows, most):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    ids = list(prints)
    want = components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    got = {r.doc_id: r for r in simhash.simhash_components(docs, most=most).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: r.component_id for k, r in got.items()} == want


def test_near_duplicates_recall(spark):
    """At least nine of ten pairs of Jaccard similarity 0.8 or more end up in one group, and nothing else does."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(80, 300))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a // 4 * 4, a // 4 * 4 + 4) if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = dict(simhash.near_duplicates(df).collect())
    want = components(links, range(len(texts)))
    assert len(links) > 150 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(want[k] == want[v] for k, v in got.items())


def test_near_duplicates_do_not_depend_on_bucket_sizes(spark):
    """Buckets that are dealt into groups give the components of buckets that are not."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(simhash.near_duplicates(df).collect())
    assert len(set(want.values())) < 120
    assert dict(simhash.near_duplicates(df, most=2).collect()) == want


def test_near_duplicates_within_a_template_family(spark):
    """Pairs at 0.83 among hundreds at 0.72, which are near in bits and fail: similar ones are found, nothing else is joined."""
    rng = random.Random(8)
    new = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    template = new(200)
    texts = [template[:-32] + new(32) for _ in range(300)]
    for k in range(20):
        texts.append(texts[k][:-18] + new(18))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = dict(simhash.near_duplicates(df).collect())
    assert sum(got[300 + k] == got[k] for k in range(20)) >= 18
    assert all(v in (k, k - 300) for k, v in got.items())


@pytest.mark.parametrize("copies, most", [(400, 4000), (5000, 4000), (400, 50)])
def test_near_duplicates_of_one_document(spark, copies, most):
    """Many copies of one text, three words changed in each: of the pairs at 0.8 or more at least nine of ten are joined, whatever a bucket holds."""
    rng = random.Random(copies)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts = []
    for _ in range(copies):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"w{rng.randrange(4000)}"
        texts.append(copy)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = dict(simhash.near_duplicates(df, most=most).collect())
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts[:400]]
    links = [(a, b) for a in range(400) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) > 1000 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)


def test_near_duplicates_count_each_shingle_once(spark):
    """A line that is repeated doesn't outweigh the text, and texts that share only such a line aren't equal."""
    rng = random.Random(9)
    new = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(5):
        base = new(600)
        texts += [base + new(10) * 20 for _ in range(2)]
    line = new(9)
    texts += [line * 50 + new(30) for _ in range(2)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert dict(simhash.near_duplicates(df).collect()) == {k: k // 2 * 2 if k < 10 else k for k in range(12)}


def test_proposals_on_keys_of_both_signs(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 64, size=(2, 2), dtype=np.uint64)[rng.integers(0, 2, 300)]
    for _ in range(14):
        keys ^= (np.uint64(1) << rng.integers(0, 64, (300, 2), dtype=np.uint64)) * rng.integers(0, 2, (300, 2), dtype=np.uint64)
    rows = [(k, *pair, 100, 0, 0) for k, pair in enumerate(keys.view(np.int64).tolist())]
    units = simhash._units(spark.createDataFrame(rows, "rep long, k0 long, k1 long, size long, turn int, bucket long"), 4000)
    out = simhash._dealt(units).mapInArrow(simhash._proposals(20, 0.8, 300), "a long, b long, turn long, bucket long, g0 long, g1 long")
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if np.bitwise_count(keys[a] ^ keys[b]).sum() <= 20}
    assert len(want) > 1000 and {(r.a, r.b) for r in out.collect()} == want


def test_quality_counts_and_verdicts(spark, docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r["text"])), dup, len(covered))
        g = got[r["doc_id"]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == counts
        assert g.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (g.base_failed and g.kept)
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    judged = [(labels[k], g.kept) for k, g in got.items() if k in labels and not g.base_failed]
    assert all(kept for good, kept in judged if good) and sum(not kept for good, kept in judged if not good) >= 0.9 * sum(not good for good, _ in judged)


def test_quality_quantiles_match_sorted_values(docs):
    rules = quality.default_rules()
    counts = quality.measure(docs).cache()
    values = collections.defaultdict(list)
    for r in counts.select("lang", rules[1].bin.alias("v")).collect():
        values[r.lang].append(r.v)
    for r in quality._quartiles(quality.sketch(counts, rules), ["lang"]).where("rule = 'word_length'").collect():
        v = sorted(values[r.lang])
        assert (r.total, r.q1, r.q3) == (len(v), v[math.ceil(len(v) / 4) - 1], v[math.ceil(3 * len(v) / 4) - 1])


def test_stored_sketches_merge(spark, docs):
    """Sketches of parts, written and read again, add up to that of the whole, and a part judged with the others' sketch agrees with the whole."""
    rules = quality.default_rules()
    path = new_path(spark, "sketches")
    kept = quality.measure(docs).where(~quality._base_failed())
    for k in range(3):
        quality.sketch(kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k), rules).write.parquet(f"{path}/part={k}")
    parts = [spark.read.parquet(f"{path}/part={k}") for k in range(3)]
    whole = quality.sketch(kept, rules)
    assert sorted(map(tuple, quality.merged(*parts).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    verdicts = dict(quality.judge(docs).select("doc_id", "kept").collect())
    mine = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    again = dict(quality.judge(mine, stored=quality.merged(*parts[1:])).select("doc_id", "kept").collect())
    assert again == {k: verdicts[k] for k in again} and 20 < len(again) < len(verdicts)


def test_kept_against_brute_force(docs, rows):
    """Every verdict from sorted values: quartiles by language and by source, averaged by count."""
    counts = {r.doc_id: r for r in quality.judge(docs).collect()}
    about = {r["doc_id"]: (r["lang"], r["source"]) for r in rows}
    for r in rows:
        assert counts[r["doc_id"]].n_marks == len(re.findall(r"[!-/:-@\[-`{-~]", r["text"]))
    measures = {
        "marks": (lambda c: min(1000, c.n_marks * 1000 // max(1, c.word_chars)), 3, 6), "word_length": (lambda c: min(10_000, c.word_chars * 100 // max(1, c.n_words)), 10, 6),
        "symbols": (lambda c: min(1000, c.n_symbols * 1000 // max(1, c.word_chars)), 10, 3),
        "dup_lines": (lambda c: min(1000, c.n_dup_lines * 1000 // max(1, c.n_lines)), 200, 3), "repeats": (lambda c: min(1000, c.n_repeat_words * 1000 // max(1, c.n_words)), 150, 3),
    }
    by_quartiles = set()
    bad = {k for k, c in counts.items() if c.base_failed}
    for name, (measure, least, reach) in measures.items():
        values = collections.defaultdict(list)
        for k, c in counts.items():
            if not c.base_failed:
                for group in (about[k], about[k][0]):
                    values[group].append(measure(c))

        def bounds(group):
            v = sorted(values[group])
            q1, q3 = v[math.ceil(len(v) / 4) - 1], v[math.ceil(3 * len(v) / 4) - 1]
            spread = reach * max(q3 - q1, least)
            return q1 - spread, q3 + spread, spread, q3 - q1 > least

        for k, c in counts.items():
            if c.base_failed:
                continue
            (low, high, _, apart), (lang_low, lang_high, spread, lang_apart) = bounds(about[k]), bounds(about[k][0])
            n = len(values[about[k]])
            top = min((n * high + 100 * lang_high) / (n + 100), lang_high + spread)
            bottom = max((n * low + 100 * lang_low) / (n + 100), lang_low - spread)
            if measure(c) > top or name == "word_length" and measure(c) < bottom:
                bad.add(k)
                if apart and lang_apart:
                    by_quartiles.add(k)
    assert {k for k, c in counts.items() if not c.kept} == bad
    assert len(by_quartiles) > 0.9 * sum(not counts[k].base_failed for k in bad)


def test_kept_stage_agrees_with_judge(docs):
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}


def left_by(rows):
    """Brute force: {doc_id: (words, removed, digest of what is left)}."""
    first, words = {}, {r["doc_id"]: (r["text"] or "").encode().split() for r in rows}
    for doc_id in sorted(words):
        w = words[doc_id]
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (doc_id, i))
    out = {}
    for doc_id, w in words.items():
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (doc_id, i) for j in range(i, i + 20)}
        out[doc_id] = len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    return out


def removed(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_substrings(docs, rows):
    want = left_by(rows)
    assert sum(n for _, n, _ in want.values()) > 1000
    assert removed(substrings.dedup_in_batches(docs, parts=(0.3, 0.6))) == want


def test_window_index_lasts(spark, docs, rows):
    """An index that other sessions open: batches meet runs, and compacted runs, of before; a batch that reaches back is refused."""
    ids = sorted(r["doc_id"] for r in rows)
    cuts = [ids[0], *(ids[len(ids) * k // 5] for k in range(1, 5)), ids[-1] + 1]
    folder, got = new_path(spark, "lasting"), {}
    for low, high in zip(cuts, cuts[1:]):
        index = substrings.WindowIndex(spark, folder, most_runs=2)
        for name in index.runs + index.stores:  # a new session knows no table
            spark.sql(f"drop table if exists {name}")
        got |= removed(index.add(docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))))
        assert len(index.runs) <= 2
    assert got == left_by(rows)
    index = substrings.WindowIndex(spark, folder)
    assert index.last == ids[-1] and index.add(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        index.add(docs.where(F.col("doc_id") == ids[3]))


def test_window_index_of_many_batches(spark, docs, rows, monkeypatch):
    """Null ids hold back no batch; stores without a shared anchor stay shut; tables grow slower than batches; looking ids up changes nothing."""
    monkeypatch.setattr(substrings, "LOOKED_UP", 20)
    ids = sorted(r["doc_id"] for r in rows)
    index, got, opened = substrings.WindowIndex(spark, new_path(spark, "many"), most_runs=2, most_stores=3), {}, []
    shared = index._shared
    index._shared = lambda lists: opened.append(shared(lists)) or opened[-1]
    nobody = spark.createDataFrame([(None, " ".join(f"nobody{k}" for k in range(30)), "x")], "doc_id long, text string, doc_id_2 string")
    cuts = [ids[len(ids) * k // 6] for k in range(6)] + [ids[-1] + 1]
    for k in range(6):
        batch = docs.where((F.col("doc_id") >= cuts[k]) & (F.col("doc_id") < cuts[k + 1])).select("doc_id", "text")
        if k == 0:
            assert len(index.add(nobody).collect()) == 1 and index.last is None
        got |= removed(index.add(batch.unionByName(nobody.select("doc_id", "text"))))
        assert got.pop(None)[:2] == (30, 0)
    assert got == left_by(rows) and index.last == ids[-1]
    assert len(index.runs) <= 2 and len(index.stores) <= 3 and sorted(index.sizes) == sorted(index.runs + index.stores)
    opened.clear()
    index.add(spark.createDataFrame([(ids[-1] + 1, " ".join(f"new{k}" for k in range(40)))], "doc_id long, text string")).collect()
    assert opened == [[]]


def test_window_index_rows_of_one_document(spark):
    """Rows under one doc_id: a window that stays in one doesn't keep another's at the same place."""
    a, b = ([f"{x}{k}" for k in range(30)] for x in "ab")
    data = [(1, " ".join(a)), (2, " ".join(b)), (2, " ".join(["c", *a]))]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.WindowIndex(spark).add(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, 30): 0, (2, 30): 0, (2, 31): 30}


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def extracted(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    return [r.text for r in html_text.main_text(df).orderBy("page_id").collect()]


PROSE = "The old mill stood by the river for as long as anybody could remember, and nobody in the village knew who had built it. It burned in spring."


def test_pages_without_hints(spark):
    """No element or name says where the main text is: words and links of a block and its neighbours do."""
    menu = "<ul>" + "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(8)) + "</ul>"
    body = f"<h1>The mill</h1><p>{PROSE}</p><p>{PROSE} Second.</p><p>{PROSE} Third.</p>"
    got = extracted(spark, f"<html><body><div>{menu}</div><div>{body}</div><div>{menu}</div></body></html>")
    assert got == ["\n\n".join(["The mill", PROSE, PROSE + " Second.", PROSE + " Third."])]


def test_pages_with_embedded_elements(spark):
    article = lambda x: f"<article><p>{PROSE}</p>{x}<p>{PROSE} After.</p></article>"
    odd = ["<svg class=x/>", '<svg viewBox="0 0 1 1"/>', "<svg><path d='M0'/><text>no</text></svg>", "<math/>", "<svg>", "<option>", "<noscript><p>no</p></noscript>", "<br/>", "<hr/>", "<iframe src=x></iframe>"]
    want = f"{PROSE}\n\n{PROSE} After."
    assert [(x, t) for x, t in zip(odd, extracted(spark, *map(article, odd))) if t != want] == []
    assert extracted(spark, f'<article><p>{PROSE} <a href=/x/>and</a> so.</p></article>') == [f"{PROSE} and so."]


def test_pages_keep_named_parts_of_an_article(spark):
    names = ["side", "text-side", "notice-board", "legal", "main-banner", "alert", "disclaimer"]
    pages = [f'<nav><a href=a>Menu</a></nav><article><h1>Mills</h1><p>{PROSE}</p><div class="{n}"><p>{PROSE} Named.</p></div><p>{PROSE} After.</p></article>' for n in names]
    want = f"Mills\n\n{PROSE}\n\n{PROSE} Named.\n\n{PROSE} After."
    assert [(n, t) for n, t in zip(names, extracted(spark, *pages)) if t != want] == []
    outside = f'<div class="notice"><p>We use your data. {PROSE}</p></div><article><h1>Mills</h1><p>{PROSE}</p></article><section id="comments"><p>{PROSE} I agree.</p></section>'
    assert extracted(spark, outside) == [f"Mills\n\n{PROSE}"]


def test_page_blocks_take_linear_time():
    for page in ("<div>x" * 100_000, "<svg>x" * 100_000, "<b>x</i>" * 100_000, "<p>x<span>" * 50_000):
        began = time.perf_counter()
        html_text.blocks(page)
        assert time.perf_counter() - began < 10  # 2 s on an idle machine


def test_block_tree_on_held_out_pages(spark):
    table = html_text.labelled(pages=80, seed=99)
    names = [*html_text.FEATURES, "label"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], ", ".join(f"{n} double" for n in names))
    root = html_text.block_tree(spark)._call_java("rootNode")
    right = df.where(html_text.tree_column(root, [F.col(n) for n in html_text.FEATURES]) == F.col("label")).count()
    assert right >= 0.97 * len(table)


def test_mixing(docs, rows):
    got = mixing.mix_totals(docs).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    total = collections.Counter()
    for d, s in source.items():
        total[s] += size[d]
    names = sorted(total)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 2 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * total[s] if s in capped else weight[s] * level for s in names}
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_totals(docs.repartition(7)).collect()))


def test_mixed_corpus(docs, rows):
    """Slots in order hold blocks of words; each document's pieces of a pass follow each other and make up its text."""
    got = mixing.mix_corpus(docs.withColumns({c: F.lit(1) for c in ("row_id", "slot", "words", "said")}), block=256).collect()
    totals = {r.doc_id: r.taken for r in mixing.mix_totals(docs, block=256).collect()}
    assert [(r.slot, r.part) for r in got] == sorted((r.slot, r.part) for r in got)
    said = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for r in rows}
    taken, passes, fill = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r.words == len(r.text.split(" ")) and r.part == fill[r.slot]
        taken[r.doc_id] += r.words
        fill[r.slot] += r.words
        passes[r.doc_id, r.epoch].append(r.text)
    assert taken == collections.Counter({k: v for k, v in totals.items() if v}) and max(fill.values()) == 256
    for (doc_id, _), texts in passes.items():
        assert sum(len(t.split(" ")) for t in texts) <= len(said[doc_id]) and all(f" {t} " in f" {' '.join(said[doc_id])} " for t in texts)


def test_pipeline(spark, rows):
    """Every stage on what its predecessor kept, against brute force; the run is the stages one after another."""
    kept, by = {}, {r["doc_id"]: r for r in rows}
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        assert name == "mix_sources" or docs.columns == list(rows[0])
    ids = {n: {r.doc_id for r in kept[n]} for n in kept}
    assert ids["quality_rules"] == {r.doc_id for r in quality.judge(table(spark, SF, "documents")).where("kept").collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k in ids["quality_rules"] if (w := by[k]["text"].lower().split())}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert near and ids["near_dedup"] == set(components(near, sets).values())
    bench = {r.item_id: decontam.normalised(r.text) for r in table(spark, SF, "benchmark").collect()}
    held = {k for k in ids["near_dedup"] if any(t in decontam.normalised(by[k]["text"]) for t in bench.values())}
    assert held and ids["decontaminate"] <= ids["near_dedup"] - held and len(ids["decontaminate"]) >= len(ids["near_dedup"] - held) - 2
    for r in kept["redact_pii"]:
        assert not base_spans(r.text) and (r.text == by[r.doc_id]["text"]) == (not re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text))
    assert ids["redact_pii"] == ids["decontaminate"] >= ids["mix_sources"]  # of a source above its target some are not taken
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, kept["mix_sources"])) and [r.slot for r in whole] == sorted(r.slot for r in whole)


def test_schedule_spreads_sources_evenly(docs):
    _, _, targets = mixing.mix(docs, block=16)
    slots = mixing.schedule(targets, 16).collect()
    assert len({s.slot for s in slots}) == len(slots)
    by = collections.defaultdict(list)
    for s in slots:
        by[s.source].append((s.slot, s["rank"]))
    for source, found in by.items():
        assert sorted(rank for _, rank in found) == list(range(len(found)))
        share = len(found) / len(slots)
        for part in (len(slots) // 4, len(slots) // 2):  # any stretch from the start holds its share
            assert abs(sum(slot < part for slot, _ in found) - share * part) <= 8


def merged(text, ranks):
    """Brute force: how many tokens are left of a text once the best pair of each piece is merged again and again."""
    total = 0
    for piece in regex.findall(token_counts.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        total += len(parts)
    return total


def test_token_counts(spark, docs, rows):
    """The registered query, both versions, against words and merges counted one by one, with deletes and revisions."""
    with open(f"{token_counts.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = collections.defaultdict(lambda: [0, 0])
    changed = collections.Counter()
    for r in rows:
        label, text = labels.get(r["doc_id"]), r["text"] or ""
        if label and label.toxic == 1:
            changed["gone"] += 1
            continue
        if label and label.quality == 0:
            changed["new"] += 1
            text = re.sub(r"[#*$%&|<>]+", " ", text)
        for version, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text))), ("byte_bpe_50k", merged(text, ranks))):
            entry = want[r["source"], r["lang"], version]
            entry[0] += 1
            entry[1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in queries.op5_token_counts(spark, SF).collect()}
    assert got == dict(want) and changed["gone"] and changed["new"]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(n):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(n))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(number) <= 19 and luhn(number))
            if not bad and not (kind == "phone" and not 9 <= len(number) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.c_d@e.f x@y@z.com", "1.2.3.4.5 300.1.1.1 001.02.3.255 1.1.1", "4111 1111 1111 1111 4929348385146306", "+1 (826) 555-4081 190.137.223.204", None, "",
    "é😀 a.b@c.de", "1 " * 20_000, "a@b.co " * 3_000, "+1" * 500, "order 4111111111111112", "12 " * 20_000, "a at " * 20_000, "ab:" * 20_000, "(" * 20_000, "x" * 70 + " at y dot com", "@.@ + - 4 4", "+49 30 1234567--", "--1.2.3.4@5.6.7.8",
]


def test_pii_base_spans(spark, docs, rows):
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(HARD)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in rows} | {10_000 + k: t for k, t in enumerate(HARD)}
    for r in pii.find(docs.select("doc_id", "text").unionByName(more)).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_pii_model_on_held_out_candidates(spark):
    rows = pii.labelled(size=400, seed=77)
    df = spark.createDataFrame([(k, r["text"]) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: bool(r.spans) for r in pii.find(df).collect()}
    base = [bool(base_spans(r["text"])) for r in rows]
    judged = [(got[k], bool(r["label"])) for k, r in enumerate(rows) if not base[k]]
    found = [label for hit, label in judged if hit]
    assert sum(found) >= 0.95 * len(found) and sum(found) >= 0.7 * sum(label for _, label in judged)


def test_pii_model_on_sentences_written_by_hand(spark):
    """Sentences that no generator made and no tree was fitted on: recall of each kind, and what is left alone."""
    held = pii.HAND[1::2]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(held)], "doc_id long, text string")).collect()}
    hits = [(kind, label, any(s.startswith(kind) for s in got[k].split(",") if s)) for k, (kind, _, label) in enumerate(held)]
    for kind in pii.KINDS:
        own = [hit for k, label, hit in hits if k == kind and label]
        assert sum(own) >= 0.75 * len(own), kind
    assert sum(hit for _, label, hit in hits if not label) <= 1
    assert not {t for _, t, _ in pii.HAND[::2]} & {t for _, t, _ in held}


def test_redaction_leaves_no_base_span(docs):
    assert all(not base_spans(r.text) for r in pii.redact(docs).collect())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def best_place(item, text):
    """Brute force: the fewest edits between an item and any stretch of a text."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    places = np.arange(len(text) + 1)
    letters = np.array(list(text))
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (letters != c))
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def contamination(items, texts, q=10, rate=0.08):
    """Brute force: {(doc, item): fewest edits} of all items within their budget; short ones stand between spaces."""
    out = {}
    for d, text in texts.items():
        for k, item in items.items():
            if not item or not text:
                continue
            if len(item) < q:
                if f" {item} " in f" {text} ":
                    out[d, k] = 0
            elif (n := best_place(item, text)) <= int(len(item) * rate + 1e-9):
                out[d, k] = n
    return out


def fewest(hits):
    out = {}
    for r in hits.collect():
        out[r.doc_id, r.item_id] = min(r.edits, out.get((r.doc_id, r.item_id), r.edits))
    return out


def test_decontamination(spark, docs, rows):
    """The benchmark's items, their heads of 13 to 60 characters among them, against every text under 4,000 characters."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: decontam.normalised(r.text) for r in bench.collect()}
    items |= {1000 + n: decontam.normalised(items[k][:n]) for n, k in zip(range(13, 61), sorted(items))}
    texts = {r["doc_id"]: decontam.normalised(r["text"] or "") for r in rows if len(r["text"] or "") < 4_000}
    df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontam.contaminated(docs.where("length(text) < 4000"), df, block_chars=3_000)
    want = contamination(items, texts)
    assert len(want) > 3 and fewest(found) == want
    once = decontam.contaminated(docs.where("length(text) < 4000"), df)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, found.collect()))
    clean = {r.doc_id for r in decontam.clean(docs.where("length(text) < 4000"), df, block_chars=3_000).collect()}
    assert clean == {r["doc_id"] for r in rows if len(r["text"]) < 4_000} - {d for d, _ in want}


@pytest.mark.parametrize("low, high", [(10, 40), (40, 120), (120, 300)])
def test_decontamination_of_edited_items(spark, low, high):
    """Items with up to two edits more than their budget, in the midst of other text: exactly those within it are found."""
    rng = random.Random(high)
    letters = "abcdefghijklmnopqrstuvwxyz  "
    some = lambda n: decontam.normalised("".join(rng.choice(letters) for _ in range(n)))
    items = {k: some(rng.randint(low, high)) for k in range(60)}
    texts = {}
    for k, item in items.items():
        for extra in (0, 1, 2):
            text = list(item)
            for _ in range(rng.randint(0, decontam.Items.budget(len(item), 0.08)) + extra):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], ["0"], ["0", text[at]]])
            texts[3 * k + extra] = decontam.normalised(some(150) + " " + "".join(text) + " " + some(150))
    got = fewest(decontam.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")))
    want = contamination(items, texts)
    assert got == want and 60 < len(want) < 180


def test_chat_masks_are_what_the_speaker_says(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    said = collections.defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        said[r.conv_id, r.role].append(r.text)
    for r in chat.rotate(turns).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",")]
        assert [r.rendered[a:b] for a, b in spans] == [t + "<|im_end|>\n" for t in said[r.conv_id, r.perspective]]


def rotated(turns, me):
    """Brute force: (rendered, mask) of sorted (turn, speaker, text)."""
    out, mask = "", []
    for turn, speaker, text in sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2])):
        head = "assistant" if speaker == me else "system" if speaker == "system" else f"user name={speaker}"
        out += f"<|im_start|>{head}\n"
        if speaker == me:
            mask.append(f"{len(out)}:{len(out) + len(text) + 11}")
        out += text + "<|im_end|>\n"
    return out, ",".join(mask)


def test_chat_renders_whole_dialogues(spark):
    """One dialogue of 3,000 turns, of which some share a number or have none, holds most rows and is one row a speaker."""
    rng = random.Random(2)
    rows = [(1, 0, "system", "be kind 😀")]
    rows += [(1, None if k % 50 == 0 else k // 2, rng.choice(["ann", "bob", "cy"]), f"says {k} é" * rng.randint(0, 3)) for k in range(3000)]
    rows += [(2, 0, "ann", "hi"), (2, 10**12, "bob", "much later")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {(r.conv_id, r.perspective): (r.part, r.n_turns, r.rendered, r.mask) for r in chat.rotate(df, tasks=6).collect()}
    want = {}
    for conv, who in ((1, ("ann", "bob", "cy")), (2, ("ann", "bob"))):
        own = [r[1:] for r in rows if r[0] == conv]
        want |= {(conv, w): (0, len(own), *rotated(own, w)) for w in who}
    assert got == want
    assert chat.chunks(df, 6).where("conv_id = 1").count() > 3
    parts = chat.rotate(df, row_chars=20_000, tasks=6).where("conv_id = 1 and perspective = 'ann'").orderBy("part").collect()
    assert len(parts) > 1 and "".join(p.rendered for p in parts) == want[1, "ann"][2] and ",".join(p.mask for p in parts if p.mask) == want[1, "ann"][3]


LONG = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_known_licences_match_at_any_width(spark):
    """Each known text, with a notice of its own where it has no fixed holder, wrapped at every third width from 30 to 120."""
    holder = "Copyright (c) 2019-2024 Jane Doe, the Example Project's Contributors & Friends of a Very Long Name Indeed. All rights reserved."
    texts = [(n, t.split("\n\n", 1)[0] + f"\n\n{holder}\n\n" + t.split("\n\n", 1)[1] if t.startswith(tuple(licenses.TITLES.get(n, ()))) else f"{holder}\n\n{t}") for n, t in licenses.known_texts()]
    folder = pathlib.Path("/usr/share/common-licenses")
    texts += [(n, (folder / f).read_text()) for n, f in LONG.items() if (folder / f).exists()]
    rows, names = [], []
    for name, text in texts:
        for width in range(30, 121, 3) if len(text) < 4_000 else (45, 72, 100):
            wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n\s*\n", text))
            rows.append((len(rows), wrapped.replace("license", "licence") if width % 2 else wrapped.upper()))
            names.append(name)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [(k, n, got[k]) for k, n in enumerate(names) if got[k] != n] == []


def test_licence_notices_of_many_forms(spark):
    mit = dict(licenses.KNOWN)["MIT"].split("\n\n", 1)[1]
    heads = ["© 2020 Jane", "(c) 2020 Jane", "Copyright 2020 Jane", "Copyright (C) Jane", "Copyright Jane Doe 2021", "Portions Copyright 2001 A", "Copyright © 2020, 2021 Jane\nAll rights reserved."]
    df = spark.createDataFrame(list(enumerate(f"{h}\n{mit}" for h in heads)), "doc_id long, text string")
    assert [r.license for r in licenses.scan(df).orderBy("doc_id").collect()] == ["MIT"] * len(heads)
    changed = spark.createDataFrame([(1, mit.replace("without restriction", "with restriction"))], "doc_id long, text string")
    assert licenses.scan(changed).first().license is None


def test_licence_tables_of_any_size_give_the_same(docs, spark):
    few, many = licenses.scan(docs).collect(), licenses.scan(docs, most=5).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and any(r.notices for r in few)
    own = licenses.registry(spark.createDataFrame([("Mine", "Copyright 2020 Me\n\nDo what you like."), (None, "x")], "license string, text string"))
    found = licenses.scan(spark.createDataFrame([(1, "(c) 2024 You\ndo what\nyou LIKE")], "doc_id long, text string"), known=own)
    assert found.first().license == "Mine"


def test_known_licences_have_one_digest_each():
    assert len({licenses.digests(t)[2] for _, t in licenses.KNOWN}) == len(licenses.KNOWN)
