"""Substring dedup with a log-structured index of window fingerprints.

Which windows of ``window`` words repeat is found by a sample of shorter windows: of the ``gram``-word windows inside a
window, the one with the smallest hash is its anchor. Equal windows have equal anchors, so a window can only repeat
where its anchor does. A batch's anchors, about two of every ``window - gram + 2``, are merge-joined with the index's
immutable runs, sorted by anchor; windows whose anchor occurs elsewhere are verified by a second, independent hash of
all their words. Runs and texts are compacted by size: what is large isn't written again for what is small.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import as_bytes, deleted, new_path, shuffles_freed, text_batches, written

#: Odd multipliers of the two window hashes.
GRAM_STEP, WINDOW_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Null doc_ids stand behind all others.
LAST = (1 << 63) - 1
#: Into how many a text's copies are dealt.
SALTS = 16
#: Up to so many documents of a store are looked up by id, in the buckets and row groups that can hold them.
LOOKED_UP = 2000


class WordHashes(dict):
    """Hash of a word, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def rolled(h: np.ndarray, width: int, step: int) -> np.ndarray:
    """Polynomial hash of each run of ``width`` word hashes, by doubling."""
    out, size = None, 0
    power, span = h, 1
    while True:
        if width & span:
            if out is None:
                out, size = power, span
            else:
                n = len(h) - size - span + 1
                out = out[:n] * np.uint64(pow(step, span, 1 << 64)) + power[size : size + n]
                size += span
        if size == width:
            break
        n = len(h) - 2 * span + 1
        power = power[:n] * np.uint64(pow(step, span, 1 << 64)) + power[span : span + n]
        span *= 2
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def anchors(words: list[bytes], cache: WordHashes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, gram hashes, anchor position of each window) of a text with at least ``window`` words."""
    h = np.array(list(map(cache.__getitem__, words)), dtype=np.uint64)
    grams = rolled(h, gram, GRAM_STEP)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    at = np.concatenate([views[k : k + 65_536].argmin(axis=1) for k in range(0, len(views), 65_536)])
    return h, grams, at + np.arange(len(views))


def _anchored(grams: np.ndarray, at: np.ndarray, hits: pa.Scalar) -> np.ndarray:
    """Whether each window's anchor has one of the hashes; neighbours mostly share one, so each is looked up once."""
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return np.isin(grams[at[new]].view(np.int64), hits.values.to_numpy())[np.cumsum(new) - 1]


def _longs(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


class WindowIndex:
    """Runs of anchors of all batches so far, in a shared folder that later sessions open again.

    A run is an immutable table of (h, doc_id), an anchor's hash and where it stands, bucketed and sorted by h: a batch is
    merge-joined with it where it lies. Texts are kept bucketed and sorted by doc_id, so that documents with a common
    anchor are verified without moving a text. Which tables count is said by the newest manifest, created after them: a
    job that dies midway leaves the index as it was. One writer at a time.

    Tables stand in the order of their batches, each with its rows and, of texts, its least and largest doc_id. From
    ``most_runs`` runs (``most_stores`` texts) on, the newest two are merged, and more as far back as the one before is no
    larger than twice all behind it: what is large isn't written again for a small batch. Texts are only opened where a
    document of their range shares an anchor with the batch.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = 20, gram: int = 8, most_runs: int = 8, buckets: int | None = None, most_stores: int = 8):
        self.spark, self.most_runs, self.most_stores = spark, most_runs, most_stores
        self.folder = (folder or new_path(spark, "window-index")).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._newest()
        self.window, self.gram = (found or {}).get("window", window), (found or {}).get("gram", gram)
        self.buckets = (found or {}).get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = (found or {}).get("runs", [])
        self.stores: list[str] = (found or {}).get("stores", [])
        self.sizes: dict[str, list[int | None]] = (found or {}).get("sizes", {})
        self.last: int | None = (found or {}).get("last")
        self._number: int = (found or {}).get("number", 0)

    def _newest(self) -> dict | None:
        where = self._path(f"{self.folder}/manifests")
        if not self._store.exists(where):
            return None
        names = sorted(f.getPath().getName() for f in self._store.listStatus(where) if f.getLen() > 0)
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{names[-1]}", wholetext=True).first().value)

    def _commit(self) -> None:
        self._number += 1
        state = {"window": self.window, "gram": self.gram, "buckets": self.buckets, "runs": self.runs, "stores": self.stores, "sizes": self.sizes, "last": self.last, "number": self._number}
        out = self._store.create(self._path(f"{self.folder}/manifests/{self._number:012d}"), False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()

    def _table(self, name: str, columns: str, key: str) -> DataFrame:
        """A table of the index; a session that sees it for the first time is told how it lies."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.folder}/{name}'")
        return self.spark.table(name)

    def _run(self, name: str) -> DataFrame:
        return self._table(name, "h bigint, doc_id bigint", "h")

    def _texts(self, name: str) -> DataFrame:
        return self._table(name, "doc_id bigint, text string", "doc_id")

    def _bucketed(self, rows: DataFrame, kind: str, key: str) -> str:
        """Write rows as a table bucketed and sorted by a key, so that later merge joins don't move it."""
        name = f"talus_{kind}_{uuid.uuid4().hex}"
        ready = rows.repartition(self.buckets, key).sortWithinPartitions(key)
        with shuffles_freed(self.spark):
            ready.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        deleted(self.spark, f"{self.folder}/{name}")

    def _scan(self, source: DataFrame) -> DataFrame:
        """Of each text: words, digest and anchors."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                n_words, shas, hs = [], [], []
                for text in as_bytes(batch.column(1)):
                    words = (text or b"").split()
                    n_words.append(len(words))
                    shas.append(_sha(words))
                    if len(words) >= window:
                        _, grams, at = anchors(words, cache, window, gram)
                        h, n = np.unique(grams[at[np.concatenate([[True], at[1:] != at[:-1]])]], return_counts=True)
                        hs.append(np.repeat(h, np.minimum(n, 2)).view(np.int64))  # two rows say: repeated in the document
                    else:
                        hs.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(shas), _longs(hs)], names=["doc_id", "n_words", "sha", "hs"])

        return source.mapInArrow(run, "doc_id long, n_words long, sha string, hs array<long>")

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch and return, for each of its documents, doc_id, n_words, n_removed, kept_sha256.

        A word goes if a window over it starts earlier: in a smaller doc_id of this or an earlier batch, or before in
        the same document. So batches come in the order of doc_id; one that reaches back is refused. Rows that share a
        doc_id count as one document: of equal windows in them the earliest start stays, in each that has it there. Null
        doc_ids are one document that stands last, behind later batches too: they hold back no batch, and what an earlier
        batch gave for them isn't judged anew. Null and empty texts have no words; texts under a window stay whole; extra columns are not looked at; a batch without rows changes nothing. Of documents of a batch with
        the same words the first stands for all: the others are repeats as a whole and aren't indexed.
        """
        spark = self.spark
        text_batches(spark)
        self.compact()
        source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
        scanned = written(self._scan(source), "scanned")
        known = F.when(F.col("doc_id") != LAST, F.col("doc_id"))
        low, high, rows, nulls = scanned.agg(F.min(known), F.max(known), F.count("*"), F.count_if(F.col("doc_id") == LAST)).first()
        if low is not None and self.last is not None and low <= self.last:
            raise ValueError(f"doc_id {low} isn't behind {self.last}, the last one indexed")
        # Salted: one text may have very many copies. Only texts that have any are written so often.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        firsts = scanned.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first", salts)
        own = scanned.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(firsts, ["sha", "salt"], "left")
        own = own.select("doc_id", "n_words", "sha", "hs", F.coalesce("first", "doc_id").alias("first"))
        own = written(own.withColumn("hs", F.when(F.col("doc_id") == F.col("first"), F.col("hs"))), "copies")
        run = self._bucketed(own.select(F.explode("hs").alias("h"), "doc_id"), "run", "h")
        texts = self._bucketed(source, "texts", "doc_id")
        result = written(self._repeats(run, texts, own.drop("hs")), "repeats")
        if not rows:
            self._drop(run)
            self._drop(texts)
            return result
        self.runs, self.stores = [*self.runs, run], [*self.stores, texts]
        self.last = self.last if high is None else high
        self.sizes |= {run: [rows, None, None], texts: [rows, LAST if low is None else low, LAST if nulls else high]}
        self._commit()
        return result

    def _due(self, names: list[str], most: int) -> int:
        """How many of the newest tables are to be merged."""
        if len(names) < max(most, 2):
            return 0
        taken, behind = 1, self.sizes[names[-1]][0]
        for name in names[-2::-1]:
            if self.sizes[name][0] > 2 * behind:
                break
            taken, behind = taken + 1, behind + self.sizes[name][0]
        return max(taken, 2)

    def compact(self) -> None:
        """Merge what is due; the old tables go once a manifest names the new ones."""
        gone = []
        for names, most, kind, key, of in ((self.runs, self.most_runs, "run", "h", self._run), (self.stores, self.most_stores, "texts", "doc_id", self._texts)):
            old = names[len(names) - self._due(names, most) :]
            if not old:
                continue
            merged = of(old[0])
            for name in old[1:]:
                merged = merged.unionByName(of(name))
            new = self._bucketed(merged, kind, key)
            sizes = [self.sizes.pop(name) for name in old]
            ends = [None, None] if key == "h" else [min(s[1] for s in sizes), max(s[2] for s in sizes)]
            self.sizes[new] = [sum(s[0] for s in sizes), *ends]
            names[len(names) - len(old) :] = [new]
            gone += old
        if gone:
            self._commit()
        for name in gone:
            self._drop(name)

    def _shared(self, lists: DataFrame) -> list[DataFrame]:
        """Texts of the stores that hold a document of lists; of a store with few, only those."""
        if not self.stores:
            return []
        inside = {name: F.col("doc_id").between(*self.sizes[name][1:]) for name in self.stores}
        counts = lists.agg(*(F.count_if(inside[name]).alias(name) for name in self.stores)).first()
        out = []
        for name in self.stores:
            if 0 < counts[name] <= LOOKED_UP:
                ids = [r.doc_id for r in lists.where(inside[name]).select("doc_id").collect()]
                out.append(self._texts(name).where(F.col("doc_id").isin(ids)))
            elif counts[name]:
                out.append(self._texts(name))
        return out

    def _repeats(self, run: str, texts: str, own: DataFrame) -> DataFrame:
        spark, least = self.spark, self.window
        batch = self._run(run)
        hits = batch.groupBy("h").count().where("count > 1").select("h")
        for name in self.runs:
            hits = hits.unionByName(batch.select("h").distinct().join(self._run(name).select("h"), "h", "left_semi"))
        hits = written(hits.distinct(), "hit-anchors")
        found = batch.join(hits, "h", "left_semi").select("doc_id", "h")
        for name in self.runs:
            found = found.unionByName(self._run(name).join(hits, "h", "left_semi").select("doc_id", "h"))
        lists = written(found.groupBy("doc_id").agg(F.collect_list("h").alias("hits")), "hits")
        windows = None
        for held in (*self._shared(lists), self._texts(texts)):
            part = held.join(lists, "doc_id").mapInArrow(_windows(self.window, self.gram), "h long, w long, doc_id long, start int")
            windows = part if windows is None else windows.unionByName(part)
        starts = windows.groupBy("h", "w").agg(F.min(F.struct("doc_id", "start")).alias("x"))
        if self.last is not None:  # firsts of earlier batches are told by all that isn't first here
            starts = starts.where(F.col("x.doc_id") > self.last)
        starts = written(starts.groupBy(F.col("x.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("x.start", "w")).alias("starts")), "starts")
        cut = self._texts(texts).join(lists, "doc_id").join(starts, "doc_id", "left")
        cut = cut.mapInArrow(_cut(self.window, self.gram), "id long, sha_in string, n_removed long, kept_sha256 string").distinct()
        out = own.join(cut, (own.doc_id == cut.id) & (own.sha == cut.sha_in), "left")
        copy = (F.col("first") < F.col("doc_id")) & (F.col("n_words") >= least)
        return out.select(
            F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(_sha([]))).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )


def _windows(window: int, gram: int) -> Callable:
    """(doc_id, text, hits) -> windows whose anchor's hash is one of hits, by anchor hash and the hash of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc_id, text, hits in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), strict=True):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                h, grams, at = anchors(words, cache, window, gram)
                start = np.flatnonzero(_anchored(grams, at, hits))
                out[0].append(grams[at[start]].view(np.int64))
                out[1].append(rolled(h, window, WINDOW_STEP)[start].view(np.int64))
                out[2].append(np.full(len(start), doc_id, np.int64))
                out[3].append(start.astype(np.int32))
            kinds = (np.int64, np.int64, np.int64, np.int32)
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "w", "doc_id", "start"])

    return run


def _cut(window: int, gram: int) -> Callable:
    """(doc_id, text, hits, starts) -> what is left once windows with such an anchor go that aren't their first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, shas, removed, left = [], [], [], []
            for doc_id, text, hits, first in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                h, grams, at = anchors(words, cache, window, gram)
                repeat = _anchored(grams, at, hits)
                if first.is_valid:
                    start, w = (first.values.field(k).to_numpy() for k in (0, 1))
                    there = start < len(repeat)  # another row of the same document may be longer
                    start, w = start[there], w[there]
                    repeat[start[rolled(h, window, WINDOW_STEP)[start].view(np.int64) == w]] = False
                edges = np.zeros(len(words) + 1, np.int64)
                start = np.flatnonzero(repeat)
                edges[start] += 1
                edges[start + window] -= 1
                stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                ids.append(doc_id)
                shas.append(_sha(words))
                removed.append(len(words) - len(stay))
                left.append(_sha([words[k] for k in stay.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(shas, pa.string()), pa.array(removed, pa.int64()), pa.array(left, pa.string())],
                names=["id", "sha_in", "n_removed", "kept_sha256"],
            )

    return run


def dedup_in_batches(docs: DataFrame, parts: tuple[float, ...] = (1 / 3, 2 / 3), window: int = 20, gram: int = 8, most_runs: int = 2) -> DataFrame:
    """All documents through a fresh index, in ranges of doc_id that end at these parts of all ids.

    Where there are ``most_runs`` runs they are compacted before a batch: the third meets one run of the first two.
    """
    index = WindowIndex(docs.sparkSession, window=window, gram=gram, most_runs=most_runs)
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), list(parts))).first()[0] if parts else []
    edges = [None, *sorted(set(bounds or [])), None]
    out = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        id_ = F.col("doc_id").cast("long")
        inside = F.lit(True)
        if low is not None:
            inside = inside & ((id_ > low) | id_.isNull())
        if high is not None:
            inside = inside & (id_ <= high)
        part = index.add(docs.where(inside))
        out = part if out is None else out.unionByName(part)
    return out
