"""Chat formatting: every participant of a dialogue once as the assistant. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.llm.arrays import let, running_sum

START, END = "<|im_start|>", "<|im_end|>\n"
#: Code points after which a rendering goes on in a further row: a Spark value cannot exceed 2 GB.
ROW_CHARS = 1 << 26


def safe(text: Column) -> Column:
    """Text that cannot be mistaken for a marker of the template."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def chunks(turns: DataFrame, tasks: int | None = None) -> DataFrame:
    """(conv_id, chunk, turns): each conversation's turns in order, cut where range partitions end.

    Partitions hold like numbers of turns, so a conversation with most of all rows is spread over most tasks; nearly all
    conversations are one chunk. Chunks of a conversation are in order of turn, nulls last, then speaker and text.
    tasks: partitions; by default as many as the session shuffles to, of which small ones are joined.
    """
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.rand(3).alias("tie"),  # repeated rows are alike: any order of them is the same
    )
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text"), F.col("tie")]
    dealt = said.repartitionByRange(*([tasks] if tasks else []), *keys)
    order = F.struct(F.col("turn").isNull().alias("last"), "turn", "speaker", "text")
    return dealt.withColumn("chunk", F.spark_partition_id()).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(order)).alias("turns"))


def rotate(turns: DataFrame, system: str = "system", row_chars: int = ROW_CHARS, tasks: int | None = None) -> DataFrame:
    """One row per conversation and perspective: conv_id, perspective, part, n_turns, rendered, mask.

    turns: conv_id, turn, role (the speaker), text. For each speaker but ``system`` the whole dialogue is rendered with
    that speaker as assistant, all others as users named after themselves, and system turns as they are. mask lists the
    stretches to learn, ``start:end`` in code points of the whole rendering, end exclusive, comma-joined: what the
    assistant says with its end marker. Turns are in order of turn, nulls last, ties by speaker and text.

    Chunks of a conversation are rendered by different tasks and joined; only a rendering of over ``row_chars`` code
    points, which no row could hold, goes on in further rows: part k has the chunks that begin in its k-th stretch of
    that length, and masks still count from the dialogue's start. Null texts count as empty, null speakers are named
    unknown, null conv_ids are one conversation, repeated rows are repeated; conversations of system turns alone have no
    perspective and no row; extra columns are not looked at; no rows give no rows.
    """
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    speakers = turns.where(speaker != system).select(F.col("conv_id").cast("long").alias("of"), speaker.alias("perspective")).distinct()
    parts = chunks(turns, tasks)
    both = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.of))
    me = F.col("perspective")

    def piece(t: Column) -> Column:
        own = t.speaker == me
        head = F.when(own, F.lit("assistant")).when(t.speaker == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), safe(t.speaker)))
        return F.struct(own.alias("own"), F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(safe(t.text), F.lit(END)).alias("body"))

    def spans(p: Column) -> Column:
        ends = running_sum(F.transform(p, lambda x: (F.length(x.head) + F.length(x.body)).cast("long")))
        found = let(ends, lambda e: F.transform(p, lambda x, i: F.when(x.own, F.struct((e[i] - F.length(x.body)).alias("start"), e[i].alias("end")))))
        return F.filter(found, lambda s: s.isNotNull())

    rows = both.select("conv_id", "chunk", "perspective", F.explode(F.array(F.struct(F.transform("turns", piece).alias("pieces")))).alias("x"))
    rows = rows.select(
        "conv_id", "perspective", "chunk", F.size("x.pieces").cast("long").alias("n"), spans(F.col("x.pieces")).alias("spans"),
        F.array_join(F.transform("x.pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
    )
    upto = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0)).cast("long"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"] + F.col("at"), s["end"] + F.col("at"))), ",")
    part = F.floor(F.col("at") / row_chars).cast("long").alias("part")
    whole = rows.groupBy("conv_id", "perspective", part).agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("chunk", "text", mask.alias("mask")))).alias("c"))
    masks = F.filter(F.transform("c", lambda c: c["mask"]), lambda m: m != "")
    return whole.select("conv_id", "perspective", "part", "n_turns", F.array_join(F.transform("c", lambda c: c["text"]), "").alias("rendered"), F.array_join(masks, ",").alias("mask"))


ORACLE = f"""
with said as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations
), speakers as (
  select distinct conv_id as of, speaker as perspective from said where speaker <> 'system'
), pieces as (
  select conv_id, perspective, turn, speaker, text, speaker = perspective as own,
         '{START}' || case when speaker = perspective then 'assistant' when speaker = 'system' then 'system'
              else 'user name=' || replace(speaker, '<|', '< |') end || chr(10) as head,
         replace(text, '<|', '< |') || '<|im_end|>' || chr(10) as body
  from said join speakers on conv_id is not distinct from of
), placed as (
  select *, sum(length(head) + length(body)) over (
    partition by conv_id, perspective order by turn nulls last, speaker, text rows unbounded preceding) as till
  from pieces
)
select conv_id, perspective, cast(0 as bigint) as part, count(*) as n_turns,
       string_agg(head || body, '' order by till) as rendered,
       coalesce(string_agg(case when own then cast(till - length(body) as bigint) || ':' || cast(till as bigint) end, ',' order by till), '') as mask
from placed group by conv_id, perspective
"""
