"""Exact vector search over note chunks, and its one-hop expansion along relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import round_up_ties
from talus.operators.notes import tags_of_notes
from talus.shared import written

DECAY = 0.7
LEAST_CONFIDENCE = 0.5
MOST_HITS = 50
#: Queries of a block that are scored against a batch of chunks at a time.
SCORED = 256
#: Hits beyond two times k a query that are held before the best are picked out.
HELD = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def with_norm(chunks: DataFrame) -> DataFrame:
    """chunks with the length of their vector, computed once when they are stored."""
    return chunks.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))


def top_chunks(chunks: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The k chunks with the highest cosine similarity: note_id, chunk_index, chunk_text, score, rank (from 1).

    The query vector is a literal: each task keeps its own k best, and only those meet. Ties go by note and chunk.
    """
    size = float(sum(x * x for x in query)) ** 0.5
    vector = F.array(*(F.lit(float(x)) for x in query))
    score = dot(F.col("vector"), vector) / F.nullif(F.col("norm") * F.lit(size), F.lit(0.0))
    best = chunks.select("note_id", "chunk_index", "chunk_text", F.coalesce(score, F.lit(0.0)).alias("score"))
    order = [F.desc("score"), "note_id", "chunk_index"]
    best = best.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def top_chunks_of_many(chunks: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """Top k chunks of each of many queries (query_id, vector): query_id, note_id, chunk_index, score, rank.

    Queries are a stated set, taken in blocks, one scan of the chunks each: a block is sent to the tasks and scored there by
    matrix products. A task keeps the k best of each query across its batches, so it leaves k rows a query, of which a
    window keeps the best. This is exact, and the product of both sides; ``VectorIndex`` looks at parts of the chunks only.
    """
    out = None
    rows = queries.select("query_id", "vector").orderBy("query_id").toLocalIterator()
    while part := [r for _, r in zip(range(block), rows, strict=False)]:
        found = chunks.select("note_id", "chunk_index", "vector").mapInPandas(
            _block_scores([r.query_id for r in part], [list(r.vector) for r in part], k), "query_id long, note_id long, chunk_index int, score double"
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "query_id long, note_id long, chunk_index int, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id", "chunk_index"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


class BestHits:
    """The k best chunks of each of a block of queries so far, ties by note and chunk."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = unit(queries), k
        self.least = np.full(len(queries), -np.inf)
        self.rows = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]  # query, score, note, chunk

    def add(self, vectors: np.ndarray, notes: np.ndarray, places: np.ndarray, only: np.ndarray | None = None) -> None:
        """Score a batch, by ``only`` these queries if given; only what reaches a query's k-th best so far is looked at again."""
        only, points = np.arange(len(self.queries)) if only is None else only, unit(vectors).T
        found, held = [self.rows], len(self.rows[0])
        for at in range(0, len(only), SCORED):
            some = only[at : at + SCORED]
            scores = self.queries[some] @ points
            floor = self.least[some]
            if scores.shape[1] > self.k:  # what k of this batch beat can't stay
                floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
            q, c = np.nonzero(scores >= floor[:, None])
            found.append((some[q], scores[q, c], notes[c], places[c]))
            held += len(q)
            if held > 2 * self.k * len(self.queries) + HELD:  # many copies of one chunk tie
                self._keep(found)
                found, held = [self.rows], len(self.rows[0])
        self._keep(found)

    def _keep(self, found: list) -> None:
        self.rows = [np.concatenate(x) for x in zip(*found, strict=True)]
        self._trim()

    def _trim(self) -> None:
        q, score, note, place = self.rows
        order = np.lexsort((place, note, -score, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(self.queries)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.rows = [r[order][keep] for r in self.rows]
        last = np.searchsorted(self.rows[0], np.arange(len(self.queries)), "right")
        full = last - np.searchsorted(self.rows[0], np.arange(len(self.queries))) == self.k
        self.least[full] = self.rows[1][last[full] - 1]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _block_scores(ids: list[int], vectors: list[list[float]], k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = BestHits(np.array(vectors, dtype=np.float64), k)
        for batch in batches:
            if len(batch):
                best.add(_matrix(batch["vector"]), batch["note_id"].to_numpy(), batch["chunk_index"].to_numpy())
        q, score, note, place = best.rows
        yield pd.DataFrame({"query_id": np.array(ids, np.int64)[q], "note_id": note, "chunk_index": place.astype(np.int32), "score": score})

    return run


#: Vectors that centres are fitted on, at most; all chunks are indexed.
SAMPLE = 50_000
#: Stored vectors, at most, that are asked for to find how many lists a query must look at.
TRIED = 128
#: Chunks, and queries, of a bundle of lists or a piece of one: what a task scores at a time.
PIECE = 8192
#: Rows whose nearness to all centres is held at a time, and rows that a query's slice of a batch is dealt out as, about.
NEAR, DEALT = 1024, 16_384


class VectorIndex:
    """Chunks in lists by their nearest centre: a query looks at its nearest lists only.

    Small lists are scored in bundles of about PIECE chunks, large ones in pieces of as many, so a query is sent to each
    bundle once, with the numbers of its lists there, and not to each list.

    Centres are fitted on a sample of at most SAMPLE vectors; every chunk is in a list. ``lists`` is twice the square root
    of their number where not given. A list that holds a third of all chunks is cut into pieces like any other.
    ``probes``, the lists that a query looks at, are as many as the exact nearest of TRIED stored vectors need for a share
    of ``recall`` of them: few where vectors lie in clusters, half of the lists where they lie at random.
    """

    def __init__(self, centres: np.ndarray, chunks: DataFrame, sizes: DataFrame, probes: int):
        self.centres, self.chunks, self.sizes, self.probes = centres, chunks, sizes, probes

    @classmethod
    def build(cls, chunks: DataFrame, lists: int | None = None, recall: float = 0.95, seed: int = 7) -> VectorIndex:
        total = chunks.count()
        lists = min(lists or max(1, round(2 * total**0.5)), 4096, max(1, total))
        share = min(1.0, SAMPLE / max(1, total))
        sample = chunks.select("vector") if share == 1.0 else chunks.select("vector").sample(share, seed)
        points = sample.where("vector is not null").limit(SAMPLE).select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
        centres = np.zeros((1, 1))
        if total:
            model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine", initMode="random").fit(_not_zero(points))
            centres = unit(np.array(model.clusterCenters()))
        placed = _with_lists(chunks, centres, "vector", "note_id long, chunk_index int").withColumnRenamed("list", "_list")
        placed = written(placed, "vector-lists")
        before = Window.orderBy("_list").rowsBetween(Window.unboundedPreceding, -1)  # a row a list
        bundle = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / PIECE).cast("int")
        sizes = placed.groupBy("_list").agg(F.count("*").alias("_n")).select("_list", F.ceil(F.col("_n") / PIECE).cast("int").alias("_pieces"), bundle.alias("_bundle"))
        sizes = written(sizes, "list-sizes")
        cut = placed.join(sizes, "_list").withColumn("_piece", F.pmod(F.xxhash64("note_id", "chunk_index"), F.col("_pieces")).cast("int"))
        cut = written(cut.drop("_pieces"), "vector-index")
        tried = chunks.where("vector is not null").select("vector").sample(min(1.0, 2 * TRIED / max(1, total)), seed).limit(TRIED).collect()
        return cls(centres, cut, sizes, _lists_needed(cut, centres, [list(r.vector) for r in tried], recall))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """Top k chunks of each query (query_id, vector) among those of its ``probes`` nearest lists: query_id, note_id, chunk_index, score, rank.

        ``probes`` is what the index has measured where not given; with all lists the result is exact.
        """
        probes = min(len(self.centres), probes or self.probes)
        sizes = [(r["_list"], r["_bundle"], r["_pieces"]) for r in self.sizes.collect()]  # 4096 lists at most
        keys = ["_bundle", "_piece"]
        asked = _dealt(queries, self.centres, probes, sizes)
        per = asked.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_parts"))  # a bundle's queries are dealt out too
        asked = asked.join(per, keys).withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")).drop("_parts")
        held = self.chunks.join(per, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

        def scored(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(near):
                return pd.DataFrame({"query_id": [], "note_id": [], "chunk_index": [], "score": []})
            best = BestHits(_matrix(mine["vector"]), k)
            points, notes, places = _matrix(near["vector"]), near["note_id"].to_numpy(), near["chunk_index"].to_numpy()
            lists, number = np.unique(near["_list"].to_numpy(), return_inverse=True)
            asks = np.zeros((len(mine), len(lists)), bool)
            for q, wanted in enumerate(mine["_lists"]):
                asks[q] = np.isin(lists, wanted)
            all_ask = asks.all(axis=0)
            for own, only in [(all_ask[number], None)] + [(number == n, np.flatnonzero(asks[:, n])) for n in np.flatnonzero(~all_ask)]:
                if own.any():
                    best.add(points[own], notes[own], places[own], only)
            q, score, note, place = best.rows
            return pd.DataFrame({"query_id": mine["query_id"].to_numpy()[q], "note_id": note, "chunk_index": place.astype(np.int32), "score": score})

        keys = [*keys, "_part"]
        hits = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(scored, "query_id long, note_id long, chunk_index int, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id", "chunk_index"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _lists_needed(chunks: DataFrame, centres: np.ndarray, vectors: list[list[float]], recall: float, k: int = 10) -> int:
    """How many of its nearest lists a query must look at, so that they hold a share ``recall`` of the exact k nearest of the given vectors."""
    if not vectors:
        return len(centres)
    asked = chunks.sparkSession.createDataFrame(list(enumerate(vectors)), "query_id long, vector array<double>")
    exact = top_chunks_of_many(chunks.select("note_id", "chunk_index", "vector"), asked, k)
    where = exact.join(chunks.select("note_id", "chunk_index", "_list"), ["note_id", "chunk_index"]).select("query_id", "_list").collect()  # TRIED * k rows
    nearness = np.argsort(np.argsort(-(unit(np.array(vectors, dtype=np.float64)) @ centres.T), axis=1, kind="stable"), axis=1)
    places = np.sort([nearness[r.query_id, r["_list"]] for r in where])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1 if len(places) else len(centres)


def _not_zero(points: DataFrame) -> DataFrame:
    """Rows whose vector has a direction; cosine distance knows no other."""
    return points.where(F.exists(vector_to_array("features"), lambda x: x != 0))


def _nearest(vectors: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` centres nearest to each vector, ties by number."""
    if probes >= len(centres):
        return np.tile(np.arange(len(centres)), (len(vectors), 1))
    scores = unit(vectors) @ centres.T
    return scores.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :probes]


def _with_lists(rows: DataFrame, centres: np.ndarray, vector: str, columns: str) -> DataFrame:
    """``columns``, vector and list: the centre nearest to the row's vector."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), NEAR):
                some = batch.iloc[at : at + NEAR]
                yield some.assign(list=_nearest(_matrix(some[vector]), centres, 1)[:, 0].astype(np.int32))[[*names, "vector", "list"]]

    return rows.where(F.col(vector).isNotNull()).select(*names, F.col(vector).alias("vector")).mapInPandas(run, f"{columns}, vector array<double>, list int")


def _dealt(queries: DataFrame, centres: np.ndarray, probes: int, sizes: list[tuple[int, int, int]]) -> DataFrame:
    """query_id, vector, _bundle, _piece, _lists: a row for each piece of a bundle in which one of the query's ``probes`` nearest lists lies.

    ``sizes`` has list, bundle and number of pieces. A slice of a batch is dealt out at a time, so that what a task holds
    grows neither with the queries nor with the lists they look at.
    """
    members: dict[tuple[int, int], list[int]] = {}
    for number, bundle, pieces in sizes:
        for piece in range(pieces):
            members.setdefault((bundle, piece), []).append(number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slice_ = max(1, min(NEAR, DEALT // max(1, len(members))))
        for batch in batches:
            for at in range(0, len(batch), slice_):
                some = batch.iloc[at : at + slice_]
                asks = np.zeros((len(some), len(centres)), bool)
                np.put_along_axis(asks, _nearest(_matrix(some["vector"]), centres, probes), True, axis=1)
                for (bundle, piece), lists in members.items():
                    own = asks[:, lists]
                    there = np.flatnonzero(own.any(axis=1))
                    if len(there):
                        numbers = np.array(lists, np.int32)
                        yield some.iloc[there].assign(_bundle=bundle, _piece=piece, _lists=[numbers[own[q]] for q in there])

    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    return asked.mapInPandas(run, "query_id long, vector array<double>, _bundle int, _piece int, _lists array<int>")


def direct_hits(hits: DataFrame, notes: DataFrame, *by: str) -> DataFrame:
    """Best chunk of each note that is there and embedded: hits' columns with a new rank over notes, for each query that ``by`` names.

    Notes are looked up before chunks are thinned out, so a stale chunk never hides one that is there.
    """
    ready = notes.where("embedding_status = 'done'").select(F.col("id").alias("note_id"))
    note = Window.partitionBy(*by, "note_id")
    rows = hits.join(ready, "note_id", "left_semi").withColumn("_first", F.min("rank").over(note))
    rows = rows.withColumn("_best", F.row_number().over(note.orderBy(F.desc("score"), "rank"))).where("_best = 1").drop("_best", "rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_first"))).drop("_first")  # at most k rows a query


def both_ways(relations: DataFrame) -> DataFrame:
    """Each edge from either end: note_id, linked_id, relation_id, relation_type, confidence. A union, no OR-join."""
    columns = [F.col("id").alias("relation_id"), "relation_type", "confidence"]
    out = relations.select(F.col("source_note_id").alias("note_id"), F.col("target_note_id").alias("linked_id"), *columns)
    return out.unionByName(relations.select(F.col("target_note_id").alias("note_id"), F.col("source_note_id").alias("linked_id"), *columns))


def expand(direct: DataFrame, relations: DataFrame, notes: DataFrame, *by: str) -> DataFrame:
    """direct hits and the notes one relation away: note_id, chunk_text, score, via_relation, best first.

    A neighbour's score is its hit's times 0.7 and the confidence (0.5 at least), to three places. The first hit in rank
    that reaches a neighbour counts; direct hits are never replaced. With ``by``, this holds for each query of its own,
    and rows come in no order.
    """
    ready = notes.where("embedding_status = 'done'").select(F.col("id").alias("linked_id"))
    edges = both_ways(relations.where(F.col("confidence") >= LEAST_CONFIDENCE))
    near = direct.select(*by, "note_id", "score", "rank").join(edges, "note_id").join(ready, "linked_id", "left_semi")
    near = near.join(direct.select(*by, F.col("note_id").alias("linked_id")), [*by, "linked_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy(*by, "linked_id").orderBy("rank", "relation_id"))
    near = near.withColumn("_first", first).where("_first = 1")
    reached = near.select(
        *by, F.col("linked_id").alias("note_id"), F.lit("").alias("chunk_text"),
        round_up_ties(F.col("score") * DECAY * F.col("confidence"), 3).alias("score"), F.col("relation_type").alias("via_relation"),
    )
    own = direct.select(*by, "note_id", "chunk_text", "score", F.lit(None).cast("string").alias("via_relation"))
    return own.unionByName(reached) if by else own.unionByName(reached).orderBy(F.desc("score"), "note_id")


def search(chunks: DataFrame, notes: DataFrame, relations: DataFrame, query: Sequence[float], k: int = 10, expanded: bool = False) -> DataFrame:
    direct = direct_hits(top_chunks(chunks, query, min(k, MOST_HITS)), notes)
    if expanded:
        return expand(direct, relations, notes)
    return direct.orderBy("rank").select("note_id", "chunk_text", "score", F.lit(None).cast("string").alias("via_relation"))


def search_many(chunks: DataFrame, notes: DataFrame, relations: DataFrame, queries: DataFrame, k: int = 10, index: VectorIndex | None = None) -> DataFrame:
    """``search`` with expansion for each of many queries (query_id, vector) at once: query_id, note_id, chunk_text, score, via_relation, rank.

    Chunks are scored once a block of queries, or by an index; then all queries are thinned out, expanded and ranked
    together, each by its own windows. Only the hits, k a query at most, are written before relations are looked up.
    """
    k = min(k, MOST_HITS)
    hits = index.search(queries, k) if index else top_chunks_of_many(chunks, queries, k)
    direct = direct_hits(hits, notes, "query_id").join(chunks.select("note_id", "chunk_index", "chunk_text"), ["note_id", "chunk_index"])
    found = expand(written(direct, "direct-hits"), relations, notes, "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id")
    return found.withColumn("rank", F.row_number().over(order))


def with_note_tags(hits: DataFrame, note_tags: DataFrame) -> DataFrame:
    """hits with the sorted tags of their notes, an empty list for notes without."""
    return hits.join(tags_of_notes(note_tags), "note_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], failing: bool = False) -> DataFrame:
    """(note_id, chunk_index, chunk_text) with vector and norm; ``model`` runs once a batch on the executors.

    failing: whether a batch that the model can't embed is asked for again text by text, and a text that fails gives a
    row without a vector and with the error in ``failed``; else an error ends the job.
    """

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return model([text])[0], None
        except Exception as error:  # noqa: BLE001 - whatever a model raises becomes the chunk's state
            return None, str(error)[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["chunk_text"].tolist()
            try:
                yield batch.assign(vector=model(texts), failed=None)
            except Exception:
                if not failing:
                    raise
                got = [one(t) for t in texts]
                yield batch.assign(vector=[v for v, _ in got], failed=[f for _, f in got])

    schema = "note_id long, chunk_index int, chunk_text string, vector array<float>, failed string"
    done = with_norm(chunks.select("note_id", "chunk_index", "chunk_text").mapInPandas(run, schema))
    return done if failing else done.drop("failed")


def syncing(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """notes with those of ``ids`` (note_id) marked as being written: their vectors may be old or new until it is done."""
    own = ids.select(F.col("note_id").alias("_sync")).distinct()
    out = notes.join(own, notes.id == own["_sync"], "left")
    return out.withColumn("embedding_status", F.when(F.col("_sync").isNotNull(), "syncing").otherwise(F.col("embedding_status"))).drop("_sync")


def swapped_chunks(notes: DataFrame, chunks: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, chunks) after embedding: a note all of whose new chunks (fresh, with ``failed``) have vectors gets them in place of its old ones and is done.

    A note with a chunk that failed keeps its old chunks and is failed. Commit both tables at once.
    """
    state = fresh.groupBy(F.col("note_id").alias("_id")).agg(F.bool_and(F.col("failed").isNull()).alias("_good"))
    good = state.where("_good").select(F.col("_id").alias("note_id"))
    new = fresh.drop("failed").join(good, "note_id", "left_semi")
    out = notes.join(state, notes.id == state["_id"], "left")
    status = F.when(F.col("_good"), "done").when(~F.col("_good"), "failed").otherwise(F.col("embedding_status"))
    return out.withColumn("embedding_status", status).drop("_id", "_good"), chunks.join(good, "note_id", "left_anti").unionByName(new.select(*chunks.columns))


def finalised(notes: DataFrame, chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """notes that were left as syncing, done where the stored chunks are those of their text (texts: note_id, chunk_index, chunk_text).

    So a run that died between commit and mark is finished without asking the model again; the others still wait.
    """
    of = lambda df: df.groupBy("note_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("chunk_index", "chunk_text").cast("decimal(38,0)")).alias("digest"))
    whole = of(chunks).join(of(texts), ["note_id", "n", "digest"]).select(F.col("note_id").alias("_whole"))
    out = notes.join(whole, notes.id == whole["_whole"], "left")
    ready = (F.col("embedding_status") == "syncing") & F.col("_whole").isNotNull()
    return out.withColumn("embedding_status", F.when(ready, "done").otherwise(F.col("embedding_status"))).drop("_whole")
