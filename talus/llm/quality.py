"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talus.llm.common import ASCII_SPACE, as_bytes, text_batches, written

SYMBOLS = b"#*$%&|<>"
#: Printable ASCII other than letters and digits.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the list, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    m = len(seen)
    if m == n:
        return 0
    pair = ids[:-1] * m + ids[1:]
    if m >= 1 << 21:  # else three ids fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * m + ids[2:]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    hit = count[at] > 1
    if not hit.any():
        return 0
    mark = np.zeros(n, dtype=bool)
    for k in range(3):
        mark[k : n - 2 + k] |= hit
    return int(mark.sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text; null counts as empty. n_lines are the \\n-split lines with a word."""
    text = text or b""
    words = text.split()
    spaces = len(text) - len(text.translate(None, ASCII_SPACE))
    points = len(text.decode()) - spaces
    lines, seen, dup = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip(ASCII_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    symbols, marks = (len(text) - len(text.translate(None, of)) for of in (SYMBOLS, MARKS))
    return len(words), points, symbols, lines, dup, repeat_words(words), marks


def measure(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and source with COUNTS of the whole text."""
    text_batches(docs.sparkSession)
    keep = ["doc_id", "lang", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([text_counts(t) for t in as_bytes(batch.column(3))], dtype=np.int64).reshape(-1, len(COUNTS))
            columns = [pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns], names=[*keep, *COUNTS])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return source.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """A measure in whole bins; it fails outside the quartiles by ``reach`` times their distance, ``least`` at least.

    ``least`` is for groups whose quartiles coincide, a unit or two of how far apart those of plain prose lie.
    """

    name: str
    bin: Column
    least: int
    reach: int = 3
    both_sides: bool = False


def default_rules() -> list[Rule]:
    """Marks, symbols and repeats in thousandths, mean word length in hundredths of a character (up to 100).

    Nearly every text has punctuation and a mean word length, so their quartiles lie apart and give the cutoff; symbols,
    repeated lines and repeated words are zero in most texts, and there ``least`` mostly stands in.
    """

    def part(of: str, total: str, scale: int, most: int) -> Column:
        return F.least(F.floor(F.col(of) * scale / F.greatest(F.col(total), F.lit(1))), F.lit(most)).cast("long")

    return [
        Rule("marks", part("n_marks", "word_chars", 1000, 1000), 3, reach=6),
        Rule("word_length", part("word_chars", "n_words", 100, 10_000), 10, reach=6, both_sides=True),
        Rule("symbols", part("n_symbols", "word_chars", 1000, 1000), 10),
        Rule("dup_lines", part("n_dup_lines", "n_lines", 1000, 1000), 200),
        Rule("repeats", part("n_repeat_words", "n_words", 1000, 1000), 150),
    ]


def sketch(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(lang, source, rule, bin, n): how many documents fall in each bin.

    Bins have a fixed width and a bounded range, so a sketch has at most some thousand rows, its quantiles are right to
    one bin, and sketches of parts, sources or days merge by adding n.
    """
    bins = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), r.bin.alias("bin")) for r in rules)))
    return rows.select("lang", "source", bins.alias("x")).groupBy("lang", "source", "x.rule", "x.bin").agg(F.count("*").alias("n"))


def _quartiles(of: DataFrame, keys: list[str]) -> DataFrame:
    keys = [*keys, "rule"]
    merged = of.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return merged.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q3"),
    )


def merged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One sketch of several, of parts, days or sources: counts of equal bins are added."""
    every = first
    for more in others:
        every = every.unionByName(more)
    return every.groupBy("lang", "source", "rule", "bin").agg(F.sum("n").alias("n"))


def cutoffs(sketches: DataFrame, rules: list[Rule], prior: int = 100) -> DataFrame:
    """(lang, source, rule, low, high): bins outside of which a document fails.

    A source's quartiles give its own bounds, its language's the common ones. They are averaged, the source's weighing as
    much as it has documents and the language's as ``prior`` documents: few documents hardly move what holds for the
    language, many decide, and no number of them switches from one to the other. The result goes no further than
    the common bound once more as far from the language's quartile: a source full of junk doesn't set its own standard.
    """
    floors, reach = (F.create_map(*(F.lit(x) for r in rules for x in (r.name, of(r))))[F.col("rule")] for of in (lambda r: r.least, lambda r: r.reach))
    sided = F.col("rule").isin([r.name for r in rules if r.both_sides])
    spread = reach * F.greatest(F.col("q3") - F.col("q1"), floors)
    bounds = [F.when(sided, F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"), spread.alias("spread")]
    own = _quartiles(sketches, ["lang", "source"]).select("lang", "source", "rule", "total", *bounds)
    whole = _quartiles(sketches, ["lang"]).select(F.col("lang").alias("l"), F.col("rule").alias("r"), *(b.alias(f"lang_{n}") for b, n in zip(bounds, ("low", "high", "spread"), strict=True)))
    both = own.join(whole, own.lang.eqNullSafe(whole.l) & (own["rule"] == whole.r))
    mean = lambda side: (F.col("total") * F.col(side) + prior * F.col(f"lang_{side}")) / (F.col("total") + prior)
    return both.select(
        "lang", "source", "rule", F.greatest(mean("low"), F.col("lang_low") - F.col("lang_spread")).alias("low"),
        F.least(mean("high"), F.col("lang_high") + F.col("lang_spread")).alias("high"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _wide(limits: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each language (l) and source (s), with a column for each cutoff."""
    sides = [F.max(F.when(F.col("rule") == r.name, F.col(side))).alias(f"{r.name}_{side}") for r in rules for side in ("low", "high")]
    return limits.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(*sides)


def _beyond(rules: list[Rule]) -> Column:
    """Whether a row is outside any of its cutoffs; a cutoff that isn't there holds for nobody."""
    out = F.lit(False)
    for r in rules:
        out = out | F.coalesce(r.bin > F.col(f"{r.name}_high"), F.lit(False)) | F.coalesce(r.bin < F.col(f"{r.name}_low"), F.lit(False))
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None, prior: int = 100, stored: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. Of the rest, the sketches give
    cutoffs per language and source, which are joined back to the documents; kept is false beyond any of them. stored: a
    sketch of earlier documents, which counts with theirs.
    Null text counts as empty and fails; null lang and source are groups of their own; repeated rows are judged alike;
    extra columns are not looked at. An empty table gives an empty one.
    """
    rules = rules or default_rules()
    rows = written(measure(docs), "text-counts").withColumn("base_failed", _base_failed())
    known = sketch(rows.where(~F.col("base_failed")), rules)
    wide = _wide(cutoffs(known if stored is None else merged(known, stored), rules, prior), rules)
    out = rows.join(wide, rows.lang.eqNullSafe(wide.l) & rows.source.eqNullSafe(wide.s), "left")
    return out.select("doc_id", *COUNTS, "base_failed", (~(F.col("base_failed") | _beyond(rules))).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, prior: int = 100) -> DataFrame:
    """docs without the documents that ``judge`` would not keep; columns stay.

    Texts are measured twice, once for the cutoffs and once for the verdict: writing whole rows with their counts instead
    would leave a copy of the corpus on disk. None is shuffled. Edge cases are ``judge``'s.
    """
    rules = rules or default_rules()
    text_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("row", docs.select(F.struct("*").alias("row")).schema[0].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            got = np.array([text_counts(t) for t in as_bytes(pa.compute.cast(row.field("text"), pa.string()))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([row, *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(COUNTS)))], names=["row", *COUNTS])

    counts = written(measure(docs), "text-counts").where(~_base_failed())
    wide = written(_wide(cutoffs(sketch(counts, rules), rules, prior), rules), "cutoffs")
    rows = docs.select(F.struct("*").alias("row")).mapInArrow(run, schema).where(~_base_failed())
    out = rows.join(wide, F.col("row.lang").cast("string").eqNullSafe(wide.l) & F.col("row.source").cast("string").eqNullSafe(wide.s), "left")
    return out.where(~_beyond(rules)).select("row.*")
