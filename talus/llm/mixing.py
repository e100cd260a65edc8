"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.llm.common import WORD, written

#: The golden ratio's fractional part to more digits than a double holds, and its multiple by 2**20, modulo 1.
GOLDEN = Fraction("0.618033988749894848204586834365638117720309179805762862135448622705260")
LOW, HIGH = float(GOLDEN), float(GOLDEN * 2**20 % 1)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def golden_point(i: Column) -> Column:
    """The i-th point of the golden-ratio sequence in [0, 1); i is cut in two so that large i keep their digits."""
    return (F.shiftright(i, 20) * F.lit(HIGH) + i.bitwiseAND((1 << 20) - 1) * F.lit(LOW)) % F.lit(1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, n_docs, target): one row for each source, null being a source.

    Sources in code-point order, null last, take ``weights`` in turn and ``share`` of all words by weight; none takes
    more than ``most`` times its own words: what is cut off goes to the others by weight until none is above. The
    level to which the uncapped sources are filled rises round by round; a round sums one row a source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    sources = written(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("weight", weight),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, level = F.col("source_size") * most, None
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * level
        capped, rest = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total * share - (capped or 0.0)) / rest if rest else float("inf")
        if level is not None and new <= level or not rest:
            break
        level = new
    target = F.least(cap, F.col("weight") * F.lit(level if level is not None else 0.0)).cast("double")
    return written(sources.select("source", "source_size", "n_docs", target.alias("target")), "targets")


def schedule(targets: DataFrame, block: int, cells: int = 4096) -> DataFrame:
    """(slot, source, rank): which source fills each slot of the mix, and the how-manieth of its blocks goes there.

    Slot i belongs to the source in whose stretch of the cumulative weights the i-th golden-ratio point falls. Slots
    and stretches meet on equal cells of [0, 1). Ranks are counted in two levels, within runs of slots and over
    their counts. A source keeps as many slots as it has blocks; the few that the points leave out come last.
    """
    spark = targets.sparkSession
    blocks = F.ceil(F.round("target") / block).cast("long")
    total, n, n_sources = targets.agg(F.sum("target"), F.sum(blocks), F.count("*")).first()
    total, n = total or 0.0, n or 0
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upper = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    stretch = targets.select(
        "source", F.row_number().over(order).alias("place"), blocks.alias("blocks"), ((upper - F.col("target")) / max(total, 1e-300)).alias("lo"), (upper / max(total, 1e-300)).alias("hi")
    ).where("blocks > 0")
    cell = F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("long"), F.floor(F.col("hi") * cells).cast("long")))
    run = max(1, int(n**0.5))
    slots = spark.range(n).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"), F.floor(F.col("id") / run).alias("run"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells).cast("long"))
    hits = written(
        slots.join(stretch.withColumn("cell", cell), "cell").where("u >= lo and u < hi").select("slot", "run", "source", "blocks"), "slots"
    )
    counts = hits.groupBy("source", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    ranked = hits.withColumn("within", within)
    ranked = ranked.join(counts, ranked.source.eqNullSafe(counts.s) & (ranked.run == counts.r))
    ranked = ranked.select("slot", "source", (F.col("before") + F.col("within")).alias("rank"), "blocks").where("rank < blocks").drop("blocks")
    got = hits.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("got"))
    short = stretch.join(got, stretch.source.eqNullSafe(got.s), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    late = short.select("source", "place", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(late.select((F.lit(n) + F.col("rank") * n_sources + F.col("place")).alias("slot"), "source", "rank"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, block: int = 1024, seed: int = 17, row_id: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pieces, targets) of a mix of all documents.

    rows: row_id, doc_id, source, size. pieces: slot, part, row_id, epoch, first, words: the stretch of a document that a
    slot holds, from its word ``first`` (from 0), in order of part. Each source's documents are laid end to end in hash order of doc_id and ``seed``, one pass after another,
    and cut into blocks of ``block`` words; the last block ends at the target. Word offsets are counted in two levels,
    within hash buckets and over their sums, so no source is ever in one task. Blocks meet the slots of ``schedule``.

    Null and empty texts have size 0 and are never taken; null is a source, after all others; null doc_ids, repeated
    rows and ties are ordered by size and text hash; extra columns are not looked at. An empty table gives empty ones.
    """
    rows = written(
        docs.select(
            (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"), word_count().alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("at"), F.xxhash64(F.col("text").cast("string")).alias("tie"),
        ),
        "sizes",
    )
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    largest = targets.agg(F.max("n_docs")).first()[0] or 1
    laid = rows.where("size > 0").withColumn("bucket", F.pmod(F.col("at"), F.lit(max(1, int(largest**0.5)))))
    sums = laid.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", "tie", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    laid = laid.join(sums, laid.source.eqNullSafe(sums.s) & (laid.bucket == sums.b)).withColumn("begin", F.col("before") + F.col("within"))
    quota = targets.select(F.col("source").alias("t"), "source_size", F.round("target").cast("long").alias("quota"))
    laid = laid.join(quota, laid.source.eqNullSafe(quota.t))
    passes = F.explode(F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1))))
    laid = laid.select("row_id", "source", "size", "begin", "source_size", "quota", passes.alias("epoch"))
    laid = laid.withColumn("begin", F.col("begin") + F.col("epoch") * F.col("source_size"))
    laid = laid.where("begin < quota").withColumn("end", F.least(F.col("begin") + F.col("size"), "quota"))
    rank = F.explode(F.sequence(F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long")))
    cut = laid.select("row_id", "epoch", F.col("source").alias("s"), "begin", "end", rank.alias("r"))
    start = F.greatest(F.col("begin"), F.col("r") * block)
    words = F.least(F.col("end"), (F.col("r") + 1) * block) - start
    cut = cut.select("row_id", "epoch", "s", "r", (start - F.col("r") * block).alias("part"), (start - F.col("begin")).alias("first"), words.alias("words"))
    slots = schedule(targets, block)
    pieces = slots.join(cut, slots.source.eqNullSafe(cut.s) & (slots["rank"] == cut.r)).select("slot", "part", "row_id", "epoch", "first", "words")
    return rows, pieces, targets


def mix_corpus(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus in slot order: slot, part, doc_id, source, epoch, words, text.

    Each row is the stretch of one document that a slot holds, its words joined by single spaces; a slot's rows, in order
    of part, are its block of words. Partitions hold ranges of slots, sorted. Edge cases are those of ``mix``: documents
    without words have no rows. A document's text meets its pieces, as many as its length and the passes ask for, in one row.
    """
    spark = docs.sparkSession
    docs = written(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", F.col("text").cast("string").alias("text")), "numbered")
    rows, pieces, _ = mix(docs, row_id="row_id", **how)
    pieces = written(pieces.join(rows.select("row_id", "doc_id", "source"), "row_id"), "pieces")
    slots = (pieces.agg(F.max("slot")).first()[0] or 0) + 1
    lists = pieces.groupBy("row_id", "doc_id", "source").agg(F.collect_list(F.struct("slot", "part", "epoch", "first", "words")).alias("pieces"))
    # Texts meet ids by a shuffle at any size: pieces grow with the documents. They are cut into words after it.
    met = docs.select("row_id", "text").join(lists.hint("merge"), "row_id")
    said = F.explode(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("said")
    cut = F.transform("pieces", lambda p: F.struct(
        p["slot"].alias("slot"), p["part"].alias("part"), p["epoch"].alias("epoch"), p["words"].alias("words"),
        F.array_join(F.slice("said", (p["first"] + 1).cast("int"), p["words"].cast("int")), " ").alias("text")))
    out = met.select("doc_id", "source", "pieces", said).select("doc_id", "source", F.explode(cut).alias("x"))
    out = out.select("x.slot", "x.part", "doc_id", "source", "x.epoch", "x.words", "x.text")
    # Blocks are of equal size, so equal ranges of slots are equal shares of the corpus: nothing needs to be sampled.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(tasks, F.floor(F.col("slot") * tasks / slots).cast("int")).sortWithinPartitions("slot", "part")


def mix_totals(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    rows, pieces, targets = mix(docs, **how)
    taken = pieces.groupBy(F.col("row_id").alias("id")).agg(F.sum("words").alias("taken"))
    of = targets.select(F.col("source").alias("s"), "source_size", "target")
    out = rows.join(taken, rows.row_id == taken.id, "left")
    out = out.join(of, out.source.eqNullSafe(of.s))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
