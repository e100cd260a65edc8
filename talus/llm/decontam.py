"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters within e edits of a stretch of text shares at least m - q + 1 - q*e of its q-grams with it, and
they lie on neighbouring diagonals (place in text minus place in item). Shared q-grams are counted in bands of
diagonals that overlap by half, so any run of e + 1 diagonals is inside one of them; bands that reach the bound are
verified by an alignment that stays inside the band.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import text_batches, written

STEP = 0x9E3779B97F4A7C15
#: log2 of the slots of the first, approximate test of a q-gram.
SLOTS = 22
#: Text places that are looked at together.
BLOCK = 1 << 16
#: Cells of bands that are aligned together.
CELLS = 1 << 19


def normalised(text: str) -> str:
    """Lower case, white space as single spaces, trimmed."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram, put together from runs of doubled length: equal q-grams have equal hashes."""
    if len(points) < q:
        return np.zeros(0, dtype=np.uint64)
    power, span, out, size = points.astype(np.uint64), 1, None, 0
    while size < q:
        if q & span:
            n = len(points) - size - span + 1
            tail = power[size : size + n]
            out = tail.copy() if out is None else out[:n] * np.uint64(pow(STEP, span, 1 << 64)) + tail
            size += span
        if size < q:
            n = len(points) - 2 * span + 1
            power = power[:n] * np.uint64(pow(STEP, span, 1 << 64)) + power[span : span + n]
            span *= 2
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Grams:
    """The sorted hashes of the q-grams of items that are all counted with one q, and where each stands."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int):
        self.q = q
        parts = [(g, np.full(len(g), k, np.int64), np.arange(len(g))) for k, g in ((k, grams(p, q)) for k, p in items)]
        h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        # Places of a q-gram that overlaps itself, as in rulers, are one range: each of them is taken to have it.
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] >= q)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        self.hash, self.item, self.place, self.until = h[first], item[first].astype(np.int32), place[first].astype(np.int32), place[last].astype(np.int32)
        self.slots = np.zeros(1 << SLOTS, dtype=bool)
        self.slots[(self.hash >> np.uint64(64 - SLOTS)).astype(np.int64)] = True

    def shared(self, points: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, half band, count): how many q-grams the text shares with an item in each ``width`` of diagonals, at most.

        The text is counted a block at a time and ranges of places by half bands, so what is held grows with the half
        bands that have any, however often a q-gram repeats.
        """
        sums = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, max(0, len(points) - self.q + 1), BLOCK):
            g = grams(points[at : at + BLOCK + self.q - 1], self.q)
            maybe = np.flatnonzero(self.slots[(g >> np.uint64(64 - SLOTS)).astype(np.int64)])
            lo = np.searchsorted(self.hash, g[maybe], "left")
            n = np.searchsorted(self.hash, g[maybe], "right") - lo
            k = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, here = self.item[k].astype(np.int64), np.repeat(maybe + at, n)
            low, high = here - self.until[k], here - self.place[k]  # diagonals, both included
            w = width[item]
            half, end = low // w, high // w
            while len(half):
                count = np.minimum(high, (half + 1) * w - 1) - np.maximum(low, half * w) + 1
                sums.append(_summed(item, half, count))
                more = half < end
                item, half, end, low, high, w = item[more], half[more] + 1, end[more], low[more], high[more], w[more]
            if len(sums) > 64:
                sums = [_summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))]
        return _summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))


def _summed(item: np.ndarray, half: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts summed by item and half band, in order of both."""
    if not len(item):
        return item, half, count
    order = np.lexsort((half, item))
    item, half, count = item[order], half[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (half[1:] != half[:-1])]))
    return item[first], half[first], np.add.reduceat(count, first)


class Items:
    """A block of benchmark items. Each is counted with the longest q-grams, of ``q`` at most, that leave its bound above zero."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float):
        self.rows = [(i, p) for i, p in rows if p]
        self.points = [codes(p) for _, p in self.rows]
        size = np.array([len(p) for p in self.points], dtype=np.int64)
        self.edits = np.array([self.budget(n, rate) for n in size.tolist()], dtype=np.int64)
        own = np.minimum(q, size // (self.edits + 1))
        self.need = size - own + 1 - own * self.edits
        self.short = np.flatnonzero(size < q).tolist()
        self.grams = [Grams([(k, self.points[k]) for k in np.flatnonzero((own == n) & (size >= q)).tolist()], n) for n in np.unique(own[size >= q]).tolist()]

    @staticmethod
    def budget(m: int, rate: float) -> int:
        """Edits that an item of m characters may have."""
        return int(m * rate + 1e-9)

    def candidates(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of bands with enough shared q-grams, for each item those with most first."""
        found = [g.shared(points, self.edits + 1) for g in self.grams]
        if not sum(len(k) for k, _, _ in found):
            return []
        item, half, count = (np.concatenate(x) for x in zip(*found, strict=True))
        enough = np.bincount(item, weights=count, minlength=len(self.need)) >= self.need  # no band has more than all its item's
        chosen = enough[item]
        # Band b holds half bands b and b + 1, so each shared q-gram counts in two bands.
        item, half, count = item[chosen], half[chosen], count[chosen]
        item, band, count = _summed(np.concatenate([item, item]), np.concatenate([half, half - 1]), np.concatenate([count, count]))
        good = np.flatnonzero(count >= self.need[item])
        good = good[np.argsort(-count[good], kind="stable")]
        return [(k, b * (e + 1), (b + 2) * (e + 1) - 1) for k, b, e in zip(item[good].tolist(), band[good].tolist(), self.edits[item[good]].tolist(), strict=True)]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) in a normalised text; of overlapping places of one item, the best."""
        points = codes(text)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        whole: dict[int, list[int]] = {}
        bands: dict[int, list[tuple[int, int]]] = {}
        for k, low, high in self.candidates(points):
            starts = whole.setdefault(k, [])
            place = bisect_left(starts, low)
            if place < len(starts) and starts[place] <= high:
                continue  # nothing in this band is better
            if got := exact(self.points[k], points, low, high):
                hits.setdefault(k, []).append(got)
                insort(starts, got[1])
            else:
                bands.setdefault(k, []).append((low, high))
        for k, left in bands.items():
            e = int(self.edits[k])
            width = left[0][1] - left[0][0] + 2 * e + 1
            step = max(1, CELLS // width)
            for at in range(0, len(left), step):
                alike: dict[bytes | int, list[int]] = {}  # bands over equal stretches of text are aligned once
                for low in (low - e for low, _ in left[at : at + step]):
                    end = low + width - 1 + len(self.points[k])
                    alike.setdefault(points[low:end].tobytes() if low >= 0 and end <= len(points) else low, []).append(low)
                lows = list(alike.values())
                for row, edits, start, end in banded(self.points[k], points, [same[0] for same in lows], width, e):
                    hits.setdefault(k, []).extend((edits, start + low - lows[row][0], end + low - lows[row][0]) for low in lows[row])
        for k in self.short:
            pattern = self.rows[k][1]
            at = text.find(pattern)
            while at >= 0:
                if (at == 0 or text[at - 1] == " ") and text[at + len(pattern) : at + len(pattern) + 1] in ("", " "):
                    hits.setdefault(k, []).append((0, at, at + len(pattern)))
                at = text.find(pattern, at + 1)
        out = []
        for k, found in hits.items():
            taken: list[tuple[int, int]] = []  # in order, none overlapping
            for edits, start, end in sorted(set(found)):
                place = bisect_left(taken, (start, end))
                if (place == 0 or taken[place - 1][1] <= start) and (place == len(taken) or end <= taken[place][0]):
                    taken.insert(place, (start, end))
                    out.append((self.rows[k][0], start, end, edits))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def exact(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(0, start, end) if the item stands in the text as it is on one of the diagonals."""
    m = len(item)
    places = np.arange(max(0, low), min(high, len(text) - m) + 1)
    places = places[text[places] == item[0]]
    for start in places.tolist():
        if np.array_equal(text[start : start + m], item):
            return 0, start, start + m
    return None


def banded(item: np.ndarray, text: np.ndarray, lows: list[int], width: int, most: int) -> list[tuple[int, int, int, int]]:
    """(band, edits, start, end) of the best alignment of the whole item in each band of ``width`` diagonals from a low one, where it has at most ``most``.

    Bands are rows of one table and drop out once all their cells cost more. Cell k of a row stands for diagonal low + k;
    each carries its cost and where its alignment began.
    """
    m, n, far = len(item), len(text), most + 1
    steps = np.arange(width)
    diagonals = np.array(lows, dtype=np.int64)[:, None] + steps
    inside = (diagonals >= 0) & (diagonals <= n)
    cost, begin, band = np.where(inside, 0, far), np.where(inside, diagonals, 0), np.arange(len(lows))
    for i in range(m):
        at = diagonals + i  # text place of the character that row i + 1 meets
        inside = (at >= 0) & (at < n)
        same = inside & (text[np.clip(at, 0, n - 1)] == item[i])
        across = np.where(inside, cost + ~same, far)
        # A dropped item character comes from the next diagonal, an added text character from the one before.
        down, down_from = np.full_like(cost, far), np.zeros_like(begin)
        down[:, :-1], down_from[:, :-1] = cost[:, 1:] + 1, begin[:, 1:]
        ok = (at + 1 >= 0) & (at + 1 <= n)
        begin = np.where(down < across, down_from, begin)
        best = np.where(ok, np.minimum(down, across), far)
        run = best - steps
        lead = np.minimum.accumulate(run, axis=1)
        from_ = np.maximum.accumulate(np.where(run == lead, steps, 0), axis=1)
        cost = np.where(ok, np.minimum(lead + steps, far), far)
        begin = np.take_along_axis(begin, from_, axis=1)
        alive = cost.min(axis=1) < far
        if not alive.all():
            diagonals, cost, begin, band = diagonals[alive], cost[alive], begin[alive], band[alive]
            if not len(cost):
                return []
    k = np.argmin(cost, axis=1)
    rows = np.arange(len(k))
    found = zip(band.tolist(), cost[rows, k].tolist(), begin[rows, k].tolist(), (diagonals[rows, k] + m).tolist(), strict=True)
    return [f for f in found if f[1] <= most]


def item_blocks(benchmark: DataFrame, q: int, rate: float, block_chars: int) -> Iterator[Items]:
    """The items in blocks of about ``block_chars`` characters; the driver holds two of them at most."""
    rows: list[tuple[int, str]] = []
    size = 0
    chosen = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    for item_id, text in chosen.distinct().orderBy("item_id").toLocalIterator():
        rows.append((item_id, normalised(text)))
        size += len(text)
        if size >= block_chars:
            yield Items(rows, q, rate)
            rows, size = [], 0
    if rows:
        yield Items(rows, q, rate)


def _blocks_sent(spark: SparkSession, benchmark: DataFrame, q: int, rate: float, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """(block of items, whether another follows). Results over a block that is followed must be written before the next is asked for."""
    blocks = item_blocks(benchmark, q, rate, block_chars)
    now = next(blocks, None)
    while now is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(now)
        yield shared, following is not None
        if following is not None:
            shared.destroy()
        now = following


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits): stretches of documents within ``rate`` edits a character of an item.

    start and end are code points of the normalised text (lower case, single spaces). Every stretch within an item's
    budget is found; of overlapping ones of an item the best is returned. The items are a query set: up to
    ``block_chars`` characters of them are one scan of the documents; larger sets are taken in blocks of that size, whose
    hits are written before the next block is sent, so a larger benchmark costs more scans but no more memory. Items
    shorter than q must occur as they are, between spaces. Null or empty texts and items match nothing; repeated rows
    each match; null doc_ids keep their rows; extra columns are not looked at; empty tables give no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, start long, `end` long, edits long"
    out = None
    for shared, more in _blocks_sent(spark, benchmark, q, rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc_id, *hit)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for hit in shared.value.find(normalised(text))
                ]
                columns = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

        part = source.mapInArrow(run, schema)
        if more:
            part = written(part, "contaminated")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; columns stay.

    Each row is decided by its own text, whatever its doc_id: null, repeated or shared. Otherwise as ``contaminated``.
    """
    spark = docs.sparkSession
    text_batches(spark)
    schema = docs.select(F.struct("*").alias("row")).schema
    for shared, more in _blocks_sent(spark, benchmark, q, rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(0)
                texts = pa.compute.cast(row.field("text"), pa.string()).to_pylist()
                stays = [text is None or not shared.value.find(normalised(text)) for text in texts]
                yield pa.RecordBatch.from_arrays([row.filter(pa.array(stays, pa.bool_()))], names=["row"])

        docs = docs.select(F.struct("*").alias("row")).mapInArrow(run, schema).select("row.*")
        if more:
            docs = written(docs, "clean")
    return docs
