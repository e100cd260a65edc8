"""Ranked lexical search by MaxScore whose bounds are tightened by joint maxima of term pairs."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talus.llm.common import as_bytes, text_batches, written

#: A term's bytes are ASCII letters and digits and whatever is not ASCII; A-Z become small, all others separate.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Characters of queries that are searched for in one pass over the documents; larger query sets take several.
QUERY_CHARS = 4_000_000
#: Documents, and entries of their lists, that make a block of the index.
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1 << 18
NO_ID = 2**63 - 1


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """A block of the query set: what each asks for, and the terms of all of them by number."""

    ids: list[int | None]
    asked: list[list[int]]
    number: dict[bytes, int]
    units: list[list[tuple[int, ...]]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Queries:
        number: dict[bytes, int] = {}
        asked = [sorted({number.setdefault(t, len(number)) for t in terms_of((text or "").encode())}) for _, text in rows]
        return cls([i for i, _ in rows], asked, number)

    def pair(self, weights: list[int]) -> None:
        """Cut each query into pairs of terms of like weight, a last one alone: rare ones bound each other, and so do common ones."""
        for own in self.asked:
            order = sorted(own, key=lambda t: (-weights[t], t))
            self.units.append([tuple(sorted(order[k : k + 2])) for k in range(0, len(order), 2)])

    def pairs(self) -> list[tuple[int, int]]:
        return sorted({u for own in self.units for u in own if len(u) == 2})


def forward(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n, terms, tfs: of each document its number of terms, and which of the queries' terms it has how often."""
    text_batches(docs.sparkSession)
    number = docs.sparkSession.sparkContext.broadcast(queries.number)  # at most QUERY_CHARS characters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in as_bytes(batch.column(1)):
                words = terms_of(text)
                found = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
                sizes.append(len(words))
                terms.append([t for t, _ in found])
                tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass
class Statistics:
    n_docs: int
    length: int
    weights: list[int]

    @classmethod
    def of(cls, rows: DataFrame, terms: int) -> Statistics:
        n_docs, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row a term of the queries
        return cls(n_docs, length, [weight(n_docs, df.get(t, 0)) for t in range(terms)])

    def impacts(self, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What an occurrence list of terms adds to the score of their documents."""
        m = 10 + np.array([90 * int(n) * self.n_docs // self.length for n in sizes], np.int64)
        return np.array(self.weights, np.int64)[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


INDEX = T.StructType([
    T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("impacts", T.ArrayType(T.LongType())),
    T.StructField("pairs", T.ArrayType(T.IntegerType())), T.StructField("pair_starts", T.ArrayType(T.IntegerType())),
    T.StructField("pair_places", T.ArrayType(T.IntegerType())), T.StructField("joint", T.ArrayType(T.LongType())),
])


class Block:
    """The lists of some documents. A term's list has its documents' places and impacts; a pair's the places of those that
    have both terms, with the largest sum of the two impacts, its joint maximum.
    """

    def __init__(self, docs, terms, starts, places, impacts, pairs, pair_starts, pair_places, joint):
        self.docs, self.places, self.impacts, self.joint = docs, places, impacts, joint
        self.lists = {int(t): slice(starts[k], starts[k + 1]) for k, t in enumerate(terms)}
        self.pairs = {int(p): (k, slice(pair_starts[k], pair_starts[k + 1])) for k, p in enumerate(pairs)}
        self.pair_places = pair_places
        self.most = {t: int(impacts[s].max()) for t, s in self.lists.items()}

    def bounds(self, unit: tuple[int, ...], pair: int | None) -> tuple[int, int]:
        """The most a document can get from a unit: by one of its terms alone, and at all."""
        alone = max((self.most.get(t, 0) for t in unit), default=0)
        both = int(self.joint[self.pairs[pair][0]]) if pair in self.pairs else 0
        return alone, max(alone, both)

    def holders(self, unit: tuple[int, ...]) -> list[np.ndarray]:
        return [self.places[self.lists[t]] for t in unit if t in self.lists]


def build(rows: DataFrame, queries: Queries, stats: Statistics) -> DataFrame:
    """The index: blocks of documents in rows of their own, each with its term lists and pair intersection lists."""
    shared = rows.sparkSession.sparkContext.broadcast((queries.pairs(), stats))

    def block(ids: list, sizes: list, terms: list, tfs: list, pairs: list, stats: Statistics) -> list:
        per = np.array([len(t) for t in terms])
        flat = np.concatenate([np.asarray(t, np.int64) for t in terms])
        of = np.repeat(np.arange(len(ids)), per)
        tf = np.concatenate([np.asarray(t, np.int64) for t in tfs])
        order = np.lexsort((of, flat))
        flat, of = flat[order], of[order]
        impacts = stats.impacts(flat, tf[order], np.array(sizes)[of])
        names, starts = np.unique(flat, return_index=True)
        starts = np.append(starts, len(flat))
        lists = {int(t): slice(starts[k], starts[k + 1]) for k, t in enumerate(names)}
        found, pair_starts, pair_places, joint = [], [0], [], []
        for p, (a, b) in enumerate(pairs):
            if a not in lists or b not in lists:
                continue
            both, x, y = np.intersect1d(of[lists[a]], of[lists[b]], assume_unique=True, return_indices=True)
            if len(both):
                found.append(p)
                pair_places.append(both)
                pair_starts.append(pair_starts[-1] + len(both))
                joint.append(int((impacts[lists[a]][x] + impacts[lists[b]][y]).max()))
        ids = [NO_ID if i is None else i for i in ids]
        return [ids, names, starts, of, impacts, found, pair_starts, np.concatenate(pair_places) if pair_places else [], joint]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, stats = shared.value
        kinds = [pa.list_(pa.int64() if f.dataType.elementType == T.LongType() else pa.int32()) for f in INDEX]
        held, entries = ([], [], [], []), 0

        def closed() -> pa.RecordBatch:
            made = block(*held, pairs, stats)
            return pa.RecordBatch.from_arrays([pa.array([list(map(int, v)) if isinstance(v, list) else v], k) for v, k in zip(made, kinds, strict=True)], names=INDEX.names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not row[2]:
                    continue
                for k, v in enumerate(row):
                    held[k].append(v)
                entries += len(row[2])
                if len(held[0]) == BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    yield closed()
                    held, entries = ([], [], [], []), 0
        if held[0]:
            yield closed()

    return rows.mapInArrow(run, INDEX)


class Best:
    """The k best of a query so far; the lowest of them is what a document must beat, or equal with a smaller id."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.heap = k, floor, []

    def least(self) -> int:
        """No document below this is among the k best."""
        return max(self.floor, self.heap[0][0] if len(self.heap) == self.k else 1)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = np.lexsort((docs, -scores))[: self.k]
            scores, docs = scores[keep], docs[keep]
        for s, d in zip(scores.tolist(), docs.tolist(), strict=True):
            entry = (s, -d)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def candidates(block: Block, units: list[tuple[int, ...]], pair_number: dict, least: int) -> np.ndarray | None:
    """Places of the documents of a block that can reach ``least``, or None if none can.

    Units are taken by rising bound. While the sum of bounds stays below ``least``, documents with nothing else are
    skipped. Of the next units one term alone doesn't suffice as long as the sum with their lone bounds stays below: only
    documents of the pair's intersection list count. All that hold a term of a later unit are candidates.
    """
    bounded = sorted((block.bounds(u, pair_number.get(u))[::-1] + (u,) for u in units))
    if sum(b for b, _, _ in bounded) < least:
        return None
    found, total, k = [], 0, 0
    while total + bounded[k][0] < least:
        total += bounded[k][0]
        k += 1
    while k < len(bounded) and len(bounded[k][2]) == 2 and total + bounded[k][1] < least:
        total += bounded[k][1]
        pair = block.pairs.get(pair_number[bounded[k][2]])
        if pair is not None:
            found.append(block.pair_places[pair[1]])
        k += 1
    for _, _, unit in bounded[k:]:
        found += block.holders(unit)
    return np.unique(np.concatenate(found)) if found else None


def score(block: Block, terms: list[int], places: np.ndarray) -> np.ndarray:
    """The whole scores of documents at the given places."""
    total = np.zeros(len(places), np.int64)
    for t in terms:
        if t not in block.lists:
            continue
        own = block.lists[t]
        holders = block.places[own]
        at = np.searchsorted(holders, places)
        at[at == len(holders)] = 0
        hit = holders[at] == places
        total[hit] += block.impacts[own][at[hit]]
    return total


def floors(index: DataFrame, queries: Queries, k: int) -> list[int]:
    """For each query a score that at least k documents reach: the k-th largest impact of one of its terms or joint sum of a pair.

    Each block gives the k largest of each of its lists; a row a term or pair and place in the order reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in _blocks(batch):
                for t, own in row.lists.items():
                    best[t] = np.sort(np.append(best.get(t, np.zeros(0, np.int64)), row.impacts[own]))[-k:]
        names = [t for t, v in best.items() for _ in v]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([int(x) for v in best.values() for x in v], pa.int64())], names=["term", "impact"])

    tops = index.mapInArrow(run, "term int, impact long")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    kth = dict(tops.withColumn("rank", rank).where(F.col("rank") == k).select("term", "impact").collect())  # at most a row a term of the queries
    return [max((kth.get(t, 0) for t in own), default=0) for own in queries.asked]


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    for r in range(batch.num_rows):
        yield Block(*(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(len(INDEX))))


def find(index: DataFrame, queries: Queries, k: int, lowest: list[int]) -> DataFrame:
    """query, doc_id, score: the k best documents of each query among those that a task has seen."""
    shared = index.sparkSession.sparkContext.broadcast((queries.asked, queries.units, {p: n for n, p in enumerate(queries.pairs())}, lowest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, units, pair_number, lowest = shared.value
        best = [Best(k, f) for f in lowest]
        for batch in batches:
            for block in _blocks(batch):
                for own, cut, top in zip(asked, units, best, strict=True):
                    places = candidates(block, cut, pair_number, top.least()) if cut else None
                    if places is not None:
                        scores = score(block, own, places)
                        good = scores >= top.least()
                        top.add(scores[good], block.docs[places[good]])
        rows = [(q, -d, s) for q, top in enumerate(best) for s, d in top.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def _query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The query set a block at a time: it is stated, and the driver holds one block of it."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        held.append(tuple(row))
        size += len(row[1] or "")
        if size >= QUERY_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each row of ``items``, equal scores by doc_id.

    Null texts have no terms; items without terms or hits have no rows; repeated items are asked once each. Null doc_ids
    come last among equal scores; of repeated doc_ids each row is a document of its own. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    for rows in _query_blocks(items):
        found = search_block(docs, Queries.of(rows), k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    """One block of queries: count, index, then search; what a task finds is at most k rows a query."""
    spark = docs.sparkSession
    rows = written(forward(docs, queries), "term-counts")
    stats = Statistics.of(rows, len(queries.number))
    queries.pair(stats.weights)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = written(build(rows.where(F.size("terms") > 0), queries, stats), "search-index")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # blocks are large rows
    try:
        hits = written(find(index, queries, k, floors(index, queries, k)), "hits")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame(list(enumerate(queries.ids)), "query long, item_id long")
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "query")
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


#: DuckDB SQL of ``search`` with k = 10.
ORACLE = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
  i as (select item_id, row_number() over () as q, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from benchmark),
  asked as (select distinct q, item_id, unnest(words) as term from i),
  total as (select count(*) filter (len(words) > 0) as nd, sum(len(words))::bigint as l from d),
  occ as (select r, doc_id, len(words) as n, unnest(words) as term from d),
  tf as (select r, doc_id, n, term, count(*) as tf from occ where term in (select term from asked) group by all),
  w as (select term, floor(1000 * ln((2 * max(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term),
  scored as (select q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::bigint as score
             from tf join asked using (term) join w using (term), total group by all)
select item_id, row_number() over (partition by q order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""
