"""SimHash near-dedup by a binary-trie self-join.

Exact for the contract (``link_fingerprints``: all links of 64-bit fingerprints within a Hamming budget) and
approximate for shingle similarity (``near_duplicates``: wide fingerprints whose share of differing bits
estimates the similarity of the shingle sets).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import as_bytes, text_batches, written
from talus.llm.components import connected_components
from talus.llm.trie import Forest, close_pairs

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Node pairs of wide fingerprints that are split at a time, and pairs that are held against sets at a time.
PIECE, SLICE = 1 << 15, 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> np.ndarray:
    """64 majority bits for each seed over the XXH64 of a text's word shingles, repeats included.

    Lower-cases A-Z. Fewer words than a shingle: their whole sequence is the one shingle; none: zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(len(seeds), dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    spans = list(zip(first[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    out = []
    for seed in seeds:
        on = np.zeros(64, dtype=np.int64)
        for at in range(0, len(spans), BLOCK):
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans[at : at + BLOCK]], dtype="<u8")
            on += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * on > len(spans), bitorder="little").view("<u8")[0])
    return np.array(out, dtype=np.uint64)


def wide_fingerprint(text: bytes | None, shingle: int) -> tuple[int, int, int, int]:
    """Two 64-bit SimHashes over the distinct word shingles, as signed longs; a digest of their set; how many there are."""
    words = (text or b"").lower().split()
    k = min(shingle, len(words))
    spans = list({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}) if k else []
    out = []
    for seed in (42, 43):
        on = np.zeros(64, dtype=np.int64)
        for at in range(0, len(spans), BLOCK):
            hashes = np.array([xxhash.xxh64_intdigest(x, seed) for x in spans[at : at + BLOCK]], dtype="<u8")
            on += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * on > len(spans), bitorder="little").view("<i8")[0]))
    digest = xxhash.xxh3_64_intdigest(b"\n".join(sorted(spans)))
    return out[0], out[1], digest - (1 << 63), len(spans)


def wide_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp0, fp1, digest, size): ``wide_fingerprint`` of each row."""
    text_batches(docs.sparkSession)
    names = ["fp0", "fp1", "digest", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([wide_fingerprint(t, shingle) for t in as_bytes(batch.column(1))], dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(4))], names=["doc_id", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def fingerprints(docs: DataFrame, shingle: int, seeds: tuple[int, ...]) -> DataFrame:
    """(doc_id, fp0, fp1, ...): one signed long for each seed."""
    text_batches(docs.sparkSession)
    names = [f"fp{k}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t, shingle, seeds) for t in as_bytes(batch.column(1))]
            longs = np.array(got, dtype=np.uint64).reshape(-1, len(seeds)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(len(seeds)))],
                names=["doc_id", *names],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _linked(groups: list[str], words: list[str], first_bit: int, budget: int):
    """A map over rows sorted by group and key: (a, b) representatives of links, at most one fewer than rows."""

    def links(t: pa.Table) -> pa.RecordBatch:
        names = np.stack([t.column(g).to_numpy() for g in groups], axis=1)
        keys = np.stack([t.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
        rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))
        second = np.concatenate([np.cumsum(side == 0), [0]])
        before = np.concatenate([[0], second[:-1]])
        ends = np.append(starts[1:], len(side))
        cross = np.maximum.reduceat(side, starts) > 0
        cuts = np.where(cross, starts + before[ends] - before[starts], starts)
        alone = cross & ((cuts == starts) | (cuts == ends))  # one of the two nodes is empty
        cuts = np.where(alone, starts, cuts)
        forest, out = Forest(len(rep)), []
        live = ~alone
        if live.any():
            bounds, at = [], []
            for s, e, c in zip(starts[live], ends[live], cuts[live], strict=True):
                if e - s > 1:
                    bounds.append((s, e))
                    at.append(c)
            if bounds:
                take = np.concatenate([np.arange(s, e) for s, e in bounds])
                size = np.array([e - s for s, e in bounds])
                new = np.cumsum(size) - size
                shift = np.array(at) - np.array([s for s, _ in bounds])
                for i, j, _ in close_pairs(keys[take], new, first_bit, budget, new + shift):
                    for x, y in zip(take[i].tolist(), take[j].tolist(), strict=True):
                        if forest.joins(x, y):
                            out.append((rep[x], rep[y]))
        a, b = (np.array([p[k] for p in out], dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            names = np.stack([t.column(g).to_numpy() for g in groups], axis=1)
            same = (names == names[-1]).all(axis=1)
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield links(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def link_fingerprints(nodes: DataFrame, budget: int = 2, most: int = 20_000, stride: int = 4) -> DataFrame:
    """(fp, rep) with distinct fp -> (a, b) links that connect all representatives within ``budget`` bits.

    A budget of k errors over k + 1 blocks of bits leaves one block without error. So the trie is walked once for
    each rotation that puts one of the blocks first; the node below that block is the unit of work. A node with
    more than ``most`` fingerprints is split by its next ``stride`` bits into its child nodes and the pairs of
    them that are within the budget, again and again; the rows of one task stay bounded whatever the data.
    Links within a task that close a circle are left out: components are the same, rows stay linear.
    """
    spark, width = nodes.sparkSession, 64 // (budget + 1)
    rotated = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), _rotate("fp", k * width).alias("key")) for k in range(budget + 1))))
    rows = nodes.select("rep", rotated.alias("x")).select("rep", "x.turn", "x.key")
    node = F.shiftrightunsigned("key", 64 - width)
    rows = rows.select("rep", "key", "turn", node.alias("a"), node.alias("b"), F.lit(0).alias("side"))
    group, depth = ["turn", "a", "b"], width
    parts = []
    while depth + stride <= 64:
        hot = rows.groupBy(*group).count().where(F.col("count") > most).drop("count")
        hot = written(hot, "hot-nodes")
        if hot.isEmpty():
            break
        parts.append((depth, rows.join(hot, group, "left_anti")))
        wide = rows.join(hot, group).withColumn("child", F.shiftrightunsigned("key", 64 - depth - stride))
        masks = [m for m in range(1 << stride) if m.bit_count() <= budget]
        other = F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))
        wide = wide.withColumn("mask", other).withColumn("mate", F.col("child").bitwiseXOR(F.col("mask")))
        within = (F.col("a") == F.col("b")) | (F.shiftrightunsigned("mate", stride) != F.shiftrightunsigned("child", stride))
        same = F.col("a") == F.col("b")
        crossed = F.col("side") == 1
        # Between two nodes each child of one side meets the children of the other side's prefix.
        opposite = F.when(crossed, F.col("a")).otherwise(F.col("b"))
        mate = F.when(same, F.col("mate")).otherwise(F.shiftleft(opposite, stride) + F.col("mate").bitwiseAND((1 << stride) - 1))
        wide = wide.withColumn("mate", mate).where(within | ~same)
        over = F.bit_count(F.col("child").bitwiseXOR(F.col("mate"))) <= budget
        rows = wide.where(over).select(
            "rep", "key", "turn", F.least("child", "mate").alias("a"), F.greatest("child", "mate").alias("b"),
            F.when(F.col("child") > F.col("mate"), 1).otherwise(0).alias("side"),
        )
        rows = written(rows, "split-nodes")
        depth += stride
    parts.append((depth, rows))
    out = None
    for first_bit, part in parts:
        ready = part.repartition(*group).sortWithinPartitions(*group, "side", "key")
        links = ready.mapInArrow(_linked(group, ["key"], min(first_bit, 63), budget), "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out


def _rotate(column: str, by: int):
    return F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, 64 - by)) if by else F.col(column)


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 2, most: int = 20_000) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Equal fingerprints are one node with their smallest doc_id, so a group of copies of any size is combined
    map-side and costs the trie one row. Null and empty texts have fingerprint zero and link like any other.
    Rows repeat as often as in the input; a null doc_id gets its group's smallest doc_id, null if there is none, and a
    fingerprint that only rows without a doc_id have links nothing.
    Extra columns are not looked at. An empty table gives an empty one.
    """
    fps = written(fingerprints(docs, shingle, (42,)), "fingerprints")
    nodes = written(fps.groupBy(F.col("fp0").alias("fp")).agg(F.min("doc_id").alias("rep")), "nodes")
    links = link_fingerprints(nodes.where("rep is not null"), budget, most)
    found = connected_components(links)
    labels = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labels, fps.fp0 == labels.fp).select(
        "doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id"
    )


#: What names a unit of work: a bucket of a shuffle, and the two groups of its rows that meet.
UNIT = ["turn", "bucket", "g0", "g1"]


def _units(rows: DataFrame, most: int) -> DataFrame:
    """Rows of buckets with their unit and side. A bucket of over ``most`` rows, or shingles for so many rows of a thousand,
    is dealt into groups, and each two of them meet.

    All pairs of a bucket meet in exactly one unit, whatever its size; a row is repeated once for each group of its bucket.
    """
    load = F.greatest(F.count("*"), F.sum("size") / 1000).alias("load")
    groups = F.ceil(2 * F.col("load") / most).cast("int").alias("groups")
    hot = written(rows.groupBy("turn", "bucket").agg(load).where(F.col("load") > most).select("turn", "bucket", groups), "hot-buckets")
    # At most tables x 2^prefix rows, whatever the data.
    both = rows.join(F.broadcast(hot), ["turn", "bucket"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("groups").cast("long")).cast("int")
    met = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    return met.select(*rows.columns, F.least("own", "other").alias("g0"), F.greatest("own", "other").alias("g1"), side.alias("side"))


def _dealt(units: DataFrame) -> DataFrame:
    return units.repartition(*UNIT).sortWithinPartitions(*UNIT, "side", *(F.col(k).bitwiseXOR(F.lit(-(1 << 63))) for k in ("k0", "k1")))


def _sides(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of units whose sides are not empty, where each unit starts, and where its second side does."""
    names = np.stack([t.column(n).to_numpy() for n in UNIT], axis=1)
    starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))
    size = np.diff(np.append(starts, len(names)))
    first = np.add.reduceat((t.column("side").to_numpy() == 0).astype(np.int64), starts)
    cross = names[starts, 2] != names[starts, 3]
    live = ~cross | ((first > 0) & (first < size))
    t = t.filter(pa.array(np.repeat(live, size)))
    size, first, cross = size[live], first[live], cross[live]
    starts = np.cumsum(size) - size
    return t, starts, np.where(cross, starts + first, starts)


def _by_unit(work, least: int = 4096):
    """A map over rows sorted by unit: ``work`` gets a table of whole units, of ``least`` rows where there are so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if not held or sum(x.num_rows for x in held) < least:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            names = np.stack([t.column(g).to_numpy() for g in UNIT], axis=1)
            same = (names == names[-1]).all(axis=1)
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield work(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _candidates(t: pa.Table, starts: np.ndarray, cuts: np.ndarray, budget: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of the pairs of units within ``budget`` whose sets are not too unlike in size to be similar."""
    if not t.num_rows:
        return
    keys = np.stack([t.column(w).to_numpy() for w in ("k0", "k1")], axis=1).view(np.uint64)
    size = t.column("size").to_numpy()
    for i, j, d in close_pairs(keys, starts, 0, budget, cuts, PIECE):
        fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        yield i[fits], j[fits], d[fits]


def _proposals(budget: int, similarity: float, nearest: int = 3):
    """A map over rows sorted by unit, side and key: candidate pairs (a, b), each row with its ``nearest`` in its unit.

    A unit with rows that have more candidates than that is named in a row without a and b.
    """

    def propose(t: pa.Table) -> pa.RecordBatch:
        t, starts, cuts = _sides(t)
        rep = t.column("rep").to_numpy()
        kept = np.zeros((3, 0), dtype=np.int64)  # of each row: itself, its nearest so far and one more, differing bits
        more = np.zeros(t.num_rows, dtype=bool)
        for i, j, d in _candidates(t, starts, cuts, budget, similarity):
            one, two, apart = kept = np.concatenate([kept, [i, j, d], [j, i, d]], axis=1).astype(np.int64)
            kept = kept[:, np.lexsort((rep[two], apart, one))]
            first = np.flatnonzero(np.concatenate([[True], kept[0, 1:] != kept[0, :-1]]))[: kept.shape[1]]
            rank = np.arange(kept.shape[1]) - np.repeat(first, np.diff(np.append(first, kept.shape[1])))
            more[kept[0, rank == nearest]] = True
            kept = kept[:, rank < nearest]
        one, two = rep[kept[0]], rep[kept[1]]
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
        names = np.unique(np.stack([t.column(n).to_numpy()[more] for n in UNIT], axis=1).astype(np.int64), axis=0)
        blank = np.concatenate([np.zeros(len(pairs), bool), np.ones(len(names), bool)])
        columns = [pa.array(np.concatenate([pairs[:, k], np.zeros(len(names), np.int64)]), mask=blank) for k in range(2)]
        columns += [pa.array(np.concatenate([np.zeros(len(pairs), np.int64), names[:, k]]), mask=~blank) for k in range(len(UNIT))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", *UNIT])

    return _by_unit(propose)


def _buckets(t: pa.Table, shuffles: list[list[int]]) -> np.ndarray:
    """The bucket of each row in each shuffle."""
    keys = [t.column(w).to_numpy().view(np.uint64) for w in ("k0", "k1")]
    out = np.zeros((t.num_rows, len(shuffles)), dtype=np.int64)
    for k, nibbles in enumerate(shuffles):
        for n in nibbles:
            out[:, k] = out[:, k] << 4 | (keys[n // 16] >> np.uint64(n % 16 * 4) & np.uint64(15)).astype(np.int64)
    return out


def _first_met(buckets: np.ndarray, turn: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the two of a pair share no bucket of an earlier shuffle: each pair is looked at in one shuffle only."""
    return (buckets[i] == buckets[j]).argmax(axis=1) == turn[i]


def _untested(budget: int, similarity: float, shuffles: list[list[int]]):
    """A map over rows with their component, sorted by unit, side and key: those that still have a candidate in another one."""

    def left(t: pa.Table) -> pa.RecordBatch:
        t, starts, cuts = _sides(t)
        comp, turn, buckets = t.column("comp").to_numpy(), t.column("turn").to_numpy(), _buckets(t, shuffles)
        used = np.zeros(t.num_rows, dtype=bool)
        for i, j, _ in _candidates(t, starts, cuts, budget, similarity):
            apart = comp[i] != comp[j]
            i, j = i[apart], j[apart]
            for at in range(0, len(i), SLICE):
                x, y = i[at : at + SLICE], j[at : at + SLICE]
                new = _first_met(buckets, turn, x, y)
                used[x[new]] = used[y[new]] = True
        t = t.filter(pa.array(used)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.columns], names=t.column_names)

    return _by_unit(left)


def _verified(budget: int, similarity: float, shuffles: list[list[int]]):
    """A map over rows with their component and shingles, sorted by unit, side and key: (a, b) links between components.

    Every candidate pair of two components is verified on its sets, unless links found before have joined the two.
    """

    def links(t: pa.Table) -> pa.RecordBatch:
        t, starts, cuts = _sides(t)
        rep, turn, buckets = t.column("rep").to_numpy(), t.column("turn").to_numpy(), _buckets(t, shuffles)
        label = np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]
        shingles = t.column("shingles").combine_chunks()
        size = shingles.value_lengths().to_numpy().astype(np.int64)
        values, ends = shingles.flatten().to_numpy(), np.cumsum(size)
        # How often a set has each value of 9 bits, odd or even: sets that differ there in n places have n shingles apart.
        count = np.bincount(np.repeat(np.arange(len(size)), size) * 512 + (values & 511), minlength=512 * len(size))
        odd = np.packbits((count & 1).astype(np.uint8).reshape(-1, 512), axis=1).view(np.uint64)
        out: list[tuple[int, int]] = []
        for i, j, _ in _candidates(t, starts, cuts, budget, similarity):
            for at in range(0, len(i), SLICE):
                x, y = i[at : at + SLICE], j[at : at + SLICE]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                both = size[x] + size[y]
                common = (both - np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64)) / 2  # at most
                may = common >= similarity * (both - common) - 1e-9
                x, y = x[may], y[may]
                new = _first_met(buckets, turn, x, y)
                for p, q in zip(x[new].tolist(), y[new].tolist(), strict=True):
                    if label[p] == label[q]:
                        continue
                    n = len(np.intersect1d(values[ends[p] - size[p] : ends[p]], values[ends[q] - size[q] : ends[q]], assume_unique=True))
                    if n >= similarity * (size[p] + size[q] - n):
                        out.append((rep[p], rep[q]))
                        label[label == label[q]] = label[p]
        a, b = (np.array([p[k] for p in out], dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _by_unit(links, 1)


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): the distinct XXH64 of a text's word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in as_bytes(batch.column(1)):
                words = (text or b"").lower().split()
                k = min(shingle, len(words))
                sets.append(sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) - (1 << 63) for i in range(len(words) - k + 1)}) if k else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, shingles array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tables: int = 24, prefix: int = 12, most: int = 4000) -> DataFrame:
    """(doc_id, component_id) of near copies: documents whose word-shingle sets have a Jaccard similarity of ``similarity``.

    Candidates come from 128-bit SimHashes: in each of ``tables`` shuffles of their bits, fingerprints that agree in the
    first ``prefix`` bits meet below one trie node, which is joined with itself within the bits by which sets of that
    similarity differ (two deviations more than the mean). Of the pairs below a node each fingerprint proposes its three
    nearest, so rows stay linear in groups of any size; where it has more, the sets of those still in different components
    are brought to the node, and every pair of two components is verified there. buckets of over ``most`` fingerprints are dealt into groups, each two
    of which meet, so a pair that shares a bucket is compared however many others are in it.
    Proposed pairs are verified on the whole shingle sets, and verified links are joined to components.

    What it finds is exact; what it finds of all similar pairs is measured in the tests. Equal shingle sets are one node.
    Rows that share a doc_id count as one document; those with a null doc_id are left out; extra columns are not looked
    at; texts without words are equal. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null")
    fps = written(wide_fingerprints(known, shingle), "wide-fingerprints")
    nodes = written(fps.groupBy("fp0", "fp1", "digest", "size").agg(F.min("doc_id").alias("rep")), "wide-nodes")
    cosine = similarity * 2 / (1 + similarity)
    share = math.acos(cosine) / math.pi
    budget = round(128 * share + 2.2 * math.sqrt(128 * share * (1 - share)))
    rng = np.random.default_rng(11)
    # Four neighbouring bits at a time: 32 nibbles, of which each shuffle puts others first.
    shuffles = [rng.choice(32, size=prefix // 4 + 6, replace=False)[: prefix // 4].tolist() for _ in range(tables)]
    turns = []
    for t, nibbles in enumerate(shuffles):
        path = F.lit(0).cast("long")
        for n in nibbles:
            path = F.shiftleft(path, 4).bitwiseOR(F.shiftrightunsigned(f"fp{n // 16}", n % 16 * 4).bitwiseAND(15))
        turns.append(F.struct(F.lit(t).alias("turn"), path.alias("bucket")))
    rows = nodes.select("rep", F.col("fp0").alias("k0"), F.col("fp1").alias("k1"), "size", F.explode(F.array(*turns)).alias("x")).select("rep", "k0", "k1", "size", "x.turn", "x.bucket")
    units = _units(rows, most)
    proposed = written(_dealt(units).mapInArrow(_proposals(budget, similarity), "a long, b long, turn long, bucket long, g0 long, g1 long"), "proposed")
    pairs, full = proposed.where("a is not null").select("a", "b"), proposed.where("a is null").select(*UNIT)
    pairs = written(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # Texts meet ids in a shuffle at any size: ids grow with the documents, so a plan that broadcasts few of them misleads.
    texts = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = written(_shingle_sets(texts.dropDuplicates(["doc_id"]), shingle), "shingle-sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    links = pairs.join(left, "a").join(right, "b").where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")
    links = written(links, "near-links")
    found = connected_components(links)
    # Where a row had more candidates than it proposed: all pairs that are still in two components.
    apart = units.join(full, UNIT, "left_semi").join(found, F.col("rep") == found.node, "left").withColumn("comp", F.coalesce("component", "rep"))
    columns = ["rep", "k0", "k1", "size", *UNIT, "side", "comp"]
    apart = _dealt(apart.select(columns))
    apart = written(apart.mapInArrow(_untested(budget, similarity, shuffles), apart.schema), "untested")
    if not apart.isEmpty():
        whole = _dealt(apart.join(sets.select(F.col("doc_id").alias("rep"), "shingles").hint("merge"), "rep"))
        rest = written(whole.mapInArrow(_verified(budget, similarity, shuffles), "a long, b long"), "late-links")
        found = connected_components(links.unionByName(rest))
    node = ["fp0", "fp1", "digest"]
    labels = nodes.join(found, nodes.rep == found.node, "left").select(*node, F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labels, node).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest doc_id; null doc_ids stay."""
    gone = written(near_duplicates(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "near-copies")
    return docs.join(gone.hint("merge"), docs.doc_id.cast("long") == gone.gone, "left_anti")
