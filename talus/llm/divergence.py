"""How the sources of a language differ: exact distances of their term shares, and the terms that lift a source above its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.llm.common import as_bytes, text_batches, written

#: A term's bytes are ASCII letters and whatever is not ASCII; A-Z become small, all others separate.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms, and their bytes, that a task holds before it passes their counts on.
HELD, HELD_BYTES = 200_000, 1 << 25
#: Sources of a block; a block of terms by two of them is compared at a time.
BLOCK, TERM_BLOCK = 64, 2048
#: Parts that the terms of a language are dealt into.
PARTS = 256
#: Terms of a group that a task holds before it reduces them to their skyband.
BAND_BUFFER = 1 << 14
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), count, docs: occurrences of each term in a group, and documents of the group with it.

    Every occurring group has a row with a null term. Counts are summed per task in a bounded table before the shuffle.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    names = ["lang", "source", "term", "count", "docs"]

    def emitted(counts: dict, holders: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            own, keys = holders[lang, source], [None, *terms]
            sums = [0, *terms.values()], [0, *(own[t] for t in terms)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary()), *(pa.array(s, pa.int64()) for s in sums)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holders, held = {}, {}, [0, 0]
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                total, having = counts.setdefault((lang, source), Counter()), holders.setdefault((lang, source), Counter())
                words = text.translate(TERMS).split()
                before = len(total)
                total.update(words)
                own = set(words)
                having.update(own)
                if len(total) > before:
                    held[0] += len(total) - before
                    held[1] += sum(map(len, own))
                if held[0] > HELD or held[1] > HELD_BYTES:
                    yield from emitted(counts, holders)
                    counts, holders, held = {}, {}, [0, 0]
        yield from emitted(counts, holders)

    counted = rows.mapInArrow(run, "lang string, source string, term binary, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count, lang_count) of terms in at least ``least`` documents of the language, and
    (lang, source, n, lang_n, v): each group's and language's occurrences of kept terms, and how many terms the language keeps.
    """
    counts = written(term_counts(docs), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= least).drop("docs")
    rows = written(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "lang_count"), "kept-terms")
    langs = rows.select("lang", "term", "count").groupBy("lang", "term").agg(F.sum("count").alias("count")).groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count("*").alias("v"))
    sums = rows.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return rows, written(groups.na.fill(0, ["n", "lang_n", "v"]), "groups")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (n + 5 v)), exactly."""
    top = (count + 5).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (n + v * 5).cast("decimal(20,0)")) + 1


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """The same of a table of counts, a column a group: long division by three digits a step stays within 64 bits."""
    below = n + 5 * v
    rest, out = counts + 5, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def distances(rows: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, a, b, value for each pair a < b of sources of a language: the sum of |share of a - share of b| over all kept terms.

    Terms are dealt into PARTS a language and sorted, so a task streams through them and compares a block of terms by a
    block of sources at a time; what it gives is one sum a pair and part. Each part opens with a row for each source, so
    that terms a source lacks count with its share of zero; those that no source of the blocks has are added at the end.
    """
    order = F.dense_rank().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    numbered = written(groups.withColumn("sid", order.cast("long")).withColumn("block", F.floor(F.col("sid") / block).cast("int")), "numbered")
    blocks = numbered.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    numbered = numbered.join(blocks, "lang")
    i, j = F.least("block", "other"), F.greatest("block", "other")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")

    def dealt(df: DataFrame) -> DataFrame:
        return df.select("*", every).withColumn("i", i).withColumn("j", j)

    heads = dealt(numbered.where("v > 0")).select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")).select(
        "lang", "i", "j", "part", F.lit(None).cast("binary").alias("term"), "sid", F.col("n").alias("count"), "v")
    named = rows.join(numbered.select("lang", "source", "sid", "block", "blocks"), ["lang", "source"])
    body = dealt(named).select("lang", "i", "j", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part"), "term", "sid", "count", F.lit(0).cast("long").alias("v"))
    keys = ["lang", "i", "j", "part"]
    sorted_rows = heads.unionByName(body).repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None

        def closed() -> Iterator[pa.RecordBatch]:
            if unit is not None:
                yield from unit.sums()

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for lang, bi, bj, part, term, sid, count, v in zip(*columns, strict=True):
                if unit is None or unit.key != (lang, bi, bj, part):
                    yield from closed()
                    unit = _Unit((lang, bi, bj, part), v, block)
                unit.take(term, sid, count)
        yield from closed()

    parts = sorted_rows.mapInArrow(run, "lang string, a long, b long, value long, seen long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    names = numbered.where("v > 0").select("lang", F.col("sid").alias("_sid"), "source", "v", share(F.lit(0).cast("long"), F.col("n"), F.col("v")).alias("zero"))
    for end in ("a", "b"):
        named_end = names.select("lang", F.col("_sid").alias(end), F.col("source").alias(f"_{end}"), F.col("zero").alias(f"_zero_{end}"), *(["v"] if end == "a" else []))
        sums = sums.join(named_end, ["lang", end])
    neither = (F.col("v") - F.col("seen")) * F.abs(F.col("_zero_a") - F.col("_zero_b"))  # kept terms that no source of the two blocks has
    sums = sums.withColumn("value", F.col("value") + neither)
    pairs = numbered.select("lang", F.col("source").alias("_a"), "v").join(numbered.select("lang", F.col("source").alias("_b")), "lang").where("v = 0 and _a < _b")
    nothing = pairs.select("lang", F.col("_a").alias("a"), F.col("_b").alias("b"), F.lit(0).cast("long").alias("value"))
    return sums.select("lang", F.col("_a").alias("a"), F.col("_b").alias("b"), "value").unionByName(nothing)


class _Unit:
    """The terms of one part of a language by two blocks of sources, summed a block of terms at a time."""

    def __init__(self, key: tuple, v: int, block: int):
        self.block, self.key, self.v, self.ids, self.n, self.at, self.term, self.used, self.seen = block, key, v, [], [], None, None, 0, 0

    def take(self, term: bytes | None, sid: int, count: int) -> None:
        if term is None:
            self.ids.append(sid)
            self.n.append(count)
            return
        if self.at is None:
            self._open()
        if term != self.term:
            if self.used == TERM_BLOCK:
                self._add()
            self.term, self.used, self.seen = term, self.used + 1, self.seen + 1
        self.counts[self.used - 1, self.at[sid]] = count

    def _open(self) -> None:
        self.at = {s: k for k, s in enumerate(self.ids)}
        self.total = np.zeros((len(self.ids), len(self.ids)), np.int64)
        self.counts = np.zeros((TERM_BLOCK, len(self.ids)), np.int64)

    def _add(self) -> None:
        p = shares(self.counts[: self.used], np.array(self.n, np.int64), self.v)
        for k in range(len(self.ids)):
            self.total[k, k + 1 :] += np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(axis=0)
        self.counts[:] = 0
        self.used = 0

    def sums(self) -> Iterator[pa.RecordBatch]:
        """One row a pair of sources, with how many terms it was summed over; a pair of one block belongs to that block's unit alone."""
        if self.at is None:
            self._open()
        self._add()
        lang, bi, bj, _ = self.key
        pairs = [(x, y) for x in range(len(self.ids)) for y in range(len(self.ids)) if self.ids[x] < self.ids[y] and (bi == bj or self.ids[x] // self.block != self.ids[y] // self.block)]
        both = [(min(x, y), max(x, y)) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(pairs), pa.string()), pa.array([self.ids[x] for x, _ in pairs], pa.int64()), pa.array([self.ids[y] for _, y in pairs], pa.int64()),
            pa.array([int(self.total[x, y]) for x, y in both], pa.int64()), pa.array([self.seen] * len(pairs), pa.int64())], names=["lang", "a", "b", "value", "seen"])


def skyband(count: np.ndarray, lang_count: np.ndarray, terms: list[bytes], k: int) -> np.ndarray:
    """Which terms fewer than k others dominate, that is have at least their count, at most their lang_count and come earlier.

    In order of count, lang_count and term all that dominate a term stand before it. A term that k dominate is dominated
    by k of the band, so each block of terms is compared with the band so far and with itself.
    """
    place = np.empty(len(terms), np.int64)
    place[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    order = np.lexsort((place, lang_count, -count))
    points = np.stack((-count, lang_count, place))[:, order]
    band = np.empty((3, 0), np.int64)
    stays = np.zeros(len(terms), bool)
    for start in range(0, len(terms), 512):
        block = points[:, start : start + 512]
        near = np.concatenate((band, block), axis=1)
        over = (near[1][:, None] <= block[1]) & (near[2][:, None] < block[2]) & (near[0][:, None] <= block[0])
        keep = over.sum(axis=0) < k
        stays[order[start : start + 512][keep]] = True
        band = np.concatenate((band, block[:, keep]), axis=1)
    return stays


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """The rows (lang, source, term, count, lang_count) that are in the k-skyband of their group's rows in their partition."""
    names = ["lang", "source", "term", "count", "lang_count"]

    def reduced(terms: list, counts: list) -> tuple[list, list]:
        both = np.array(counts, np.int64)
        stay = np.flatnonzero(skyband(both[:, 0], both[:, 1], terms, k))
        return [terms[s] for s in stay], [counts[s] for s in stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}
        for batch in batches:
            for lang, source, term, count, lang_count in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                held = groups.setdefault((lang, source), [[], [], BAND_BUFFER])
                held[0].append(term)
                held[1].append((count, lang_count))
                if len(held[0]) >= held[2]:
                    held[0], held[1] = reduced(held[0], held[1])
                    held[2] = 2 * len(held[0]) + BAND_BUFFER  # a wide band isn't reduced again and again
        for (lang, source), (terms, counts, _) in groups.items():
            terms, counts = reduced(terms, counts)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), *(pa.array([c[x] for c in counts], pa.int64()) for x in range(2))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*names).mapInArrow(run, "lang string, source string, term binary, count long, lang_count long")


def lifted_terms(rows: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """lang, source, item, value, rank: the k terms of each group whose share there exceeds that in the language most.

    The share rises with the count, so a term that k others dominate can't be among the k first, whatever the groups'
    sizes are. Partitions give the skyband of what they hold, PARTS-th parts of a group that of what comes in, and only
    what is left is ranked by the exact difference, ties by term.
    """
    once = skybands(rows.where("count > 0"), k)
    twice = skybands(once.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(16))), k)
    value = share(F.col("count"), F.col("n"), F.col("v")) - share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    found = twice.join(groups, ["lang", "source"]).withColumn("value", value).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("lang", "source", F.col("term").cast("string").alias("item"), "value", "rank")


def audit(docs: DataFrame, least: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ.

    Part ``pair``: each other source of the language, by distance; part ``term``: the ``k`` terms that stand out most.
    Null texts, languages and sources are empty ones; groups without terms count like any other; a language that keeps
    no term has distances of zero; no documents give no rows; other columns are ignored.
    """
    rows, groups = kept_counts(docs, least)
    found = distances(rows, groups)
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # a row a source
    pairs = both.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = lifted_terms(rows, groups, k).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


#: DuckDB SQL of ``audit`` with least = 30 and k = 50.
ORACLE = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
  t as (select lang, source, id, unnest(words) as term from d),
  kept as (select lang, term, count(*) as c from t group by lang, term having count(distinct id) >= 30),
  langs as (select lang, sum(c)::hugeint as n, count(*)::hugeint as v from kept group by lang),
  g as (select distinct lang, source from d),
  counts as (select t.lang, t.source, t.term, count(*) as c from t join kept k on t.lang = k.lang and t.term = k.term group by all),
  sums as (select g.lang, g.source, coalesce(sum(c), 0)::hugeint as n from g left join counts c on g.lang = c.lang and g.source = c.source group by all),
  dense as (select s.lang, s.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (s.n + 5 * l.v) as p,
              1 + (1000000000::hugeint * (k.c + 5)) // (l.n + 5 * l.v) as q
            from sums s join kept k on s.lang = k.lang join langs l on s.lang = l.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
  pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  every as (select a.lang, a.source, b.source as item, coalesce(p.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
              left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
  terms as (select lang, source, term as item, p - q as value, row_number() over (partition by lang, source order by p - q desc, term) as rank from dense where c > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from every
union all
select lang, source, 'term', item, value::bigint, rank::int from terms where rank <= 50
"""
