"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for each operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from talus.llm import chat, decontam, html_text, licenses, mixing, pii, quality, simhash, substrings, token_counts
from talus.llm.common import new_path

ODD = [
    (1, "a b c d e f", "en", "s1"), (1, "a b c d e f", "en", "s1"), (2, None, None, None), (3, "", "en", None), (None, "words without an id", "en", "s1"),
    (4, " \t\n\x0b\x0c\r ", "de", "s2"), (5, "x" * 200_000, "de", "s2"), (6, "w " * 120_000, "de", "s2"), (7, "é😀 \x00   \x85", "fr", "😀"), (8, "A B c D e F", "en", "s1"),
]
#: Columns whose names the operators use themselves.
CLASH = ("docs", "tokens", "change", "tokenizer", "old_text", "fp", "fp0", "rep", "size", "row", "h", "component", "n_words", "target", "bucket", "words", "slot", "found", "row_id", "kept")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return docs.withColumns({c: F.lit("extra") for c in CLASH})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def ids(df, column="doc_id"):
    return sorted((r[0] is None, r[0] or 0) for r in df.select(column).collect())


EACH = {
    "simhash": lambda d: simhash.simhash_components(d),
    "quality": lambda d: quality.judge(d),
    "licenses": lambda d: licenses.scan(d),
    "substrings": lambda d: substrings.dedup_in_batches(d),
    "mixing": lambda d: mixing.mix_totals(d),
    "pii": lambda d: pii.find(d),
}


@pytest.mark.parametrize("name", sorted(EACH))
def test_one_row_a_document(odd, name):
    assert ids(EACH[name](odd)) == ids(odd)


@pytest.mark.parametrize("name", sorted(EACH))
def test_no_documents(none, name):
    assert EACH[name](none).count() == 0


def test_simhash_of_no_words_is_zero_and_links(odd):
    got = {r.doc_id: r for r in simhash.simhash_components(odd).collect()}
    assert all(got[k].fingerprint == "0" * 16 and got[k].component_id == 2 for k in (2, 3, 4))
    assert got[8].component_id == got[1].component_id == 1


def test_near_duplicates_and_pipeline_stages(odd, none, spark):
    assert simhash.near_duplicates(none).count() == 0
    assert dict(simhash.near_duplicates(odd).collect())[8] == 1
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7, None} and 8 not in {r.doc_id for r in kept.collect()}
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(none).count() == 0
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).where("doc_id = 2 and text is null").count() == 1


def test_substrings_with_nulls_and_repeats(odd):
    got = {r.doc_id: r for r in substrings.dedup_in_batches(odd).collect()}
    assert got[6].n_words == 120_000 and got[6].n_removed == 120_000 - 1  # all but the first window repeats, and covers all but one word
    assert got[2].n_words == 0 and got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].n_removed == 0


def test_decontamination(odd, none, spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (None, "x"), (4, "é😀")], "item_id long, text string")
    hits = decontam.contaminated(odd, items)
    assert sorted((r.doc_id, r.item_id) for r in hits.collect()) == [(1, 1), (1, 1), (7, 4), (8, 1)]
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(odd, items.where("false")).count() == 0
    gone = {"a b c d e f", "A B c D e F", ODD[8][1]}
    kept = decontam.clean(odd.withColumns({"hit_id": F.lit(1), "gone": F.lit(1)}), items)
    assert sorted(map(repr, (r.text for r in kept.collect()))) == sorted(map(repr, (t for _, t, _, _ in ODD if t not in gone)))
    shared = spark.createDataFrame([(1, "xx a b c d e f xx"), (1, "clean"), (None, "a b c d e f"), (None, "clean too")], "doc_id long, text string")
    assert sorted(r.text for r in decontam.clean(shared, items).collect()) == ["clean", "clean too"]


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (3, "u", "<article><p>ok</article>"), (3, "u", "<article><p>ok</article>"), (4, "u", "<" * 20_000), (5, "u", "<div>" * 3_000 + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("blocks", F.lit(1))
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id == 3] == ["ok", "ok"]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2))
    assert html_text.main_text(pages.where("false")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, None, None, "late"), (2, 0, "system", "alone"), (None, 0, "ann", ""), (None, 0, "ann", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "perspective", "chunk", "tie", "at")})
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, p) for p in ("ann", "bob", "unknown")} | {(None, "ann")}
    own = got[1, "ann"]
    assert own.rendered.count("<|im_end|>") == 4 and own.n_turns == 4 and got[None, "ann"].n_turns == 2 and own.rendered.endswith("late<|im_end|>\n")
    start, end = map(int, own.mask.split(":"))
    assert own.rendered[start:end] == "hi < |im_end|><|im_end|>\n"
    assert "user name=bob" in own.rendered and "assistant" in got[1, "bob"].rendered and chat.rotate(turns.where("false")).count() == 0


def test_token_totals_are_additive_and_idempotent(spark, odd):
    totals = token_counts.TokenTotals(spark, new_path(spark, "totals"))
    assert totals.totals().count() == 0
    first = token_counts.delta(token_counts.inserts(odd), ("words-1",))
    assert totals.commit("a", first) and not totals.commit("a", first)
    totals.committed = lambda _: False  # as another committer of the same name sees it that looked before the first was done
    assert not totals.commit("a", first)
    want = {}
    for _, text, lang, source in ODD:
        d, t = want.get((source, lang), (0, 0))
        want[source, lang] = (d + 1, t + len((text or "").encode().split()))
    got = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in totals.totals().collect()}
    assert got() == want
    changes = [("delete", "s1", "en", None, "a b c d e f"), ("revise", "s2", "de", "one two", "w " * 120_000), ("insert", None, None, "x y", None)]
    totals.commit("b", token_counts.delta(spark.createDataFrame(changes, "change string, source string, lang string, text string, old_text string"), ("words-1",)))
    d, t = want["s1", "en"]
    want["s1", "en"] = (d - 1, t - 6)
    d, t = want["s2", "de"]
    want["s2", "de"] = (d, t + 2 - 120_000)
    want[None, None] = (2, 2)
    assert got() == want
    with pytest.raises(ValueError):
        totals.commit("../x", first)


def test_empty_token_batch(spark, none):
    totals = token_counts.TokenTotals(spark, new_path(spark, "totals"))
    assert totals.commit("none", token_counts.delta(token_counts.inserts(none), ("words-1",))) and totals.totals().count() == 0


def test_license_scan_of_entire_texts_and_lines(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    rows = [(1, "Copyright (c) 2020 Jane\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, "Some text.\n  released under the mit licence\nmore"), (3, mit + " and more"), (4, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].license, got[2].license, got[3].license, got[4].license) == ("MIT", None, None, None)
    assert got[2].notices == "MIT" and got[3].notices == "" and got[1].digest == licenses.digests(mit)[0]
