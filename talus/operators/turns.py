"""Turns of a conversation, and transcripts packed into a size budget.

Messages: conversation_id, sort_order, type, content, has_tool_use. A turn begins with a user message that follows one of
another type; whatever isn't from the user counts as the assistant's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import trim_all

SUBSTANTIAL = 50
CONFIRMATION = 20
SUMMARY_COST = 100


def meaningful(messages: DataFrame) -> DataFrame:
    """Without messages that only call tools."""
    return messages.where(~(F.coalesce("has_tool_use", F.lit(False)) & (F.coalesce("content", F.lit("")) == "")))


def split_turns(messages: DataFrame) -> DataFrame:
    """messages with their turn number, from 0."""
    w = Window.partitionBy("conversation_id").orderBy("sort_order")
    user = F.col("type") == "user"
    starts = F.when(user & ~F.lag(user, 1, True).over(w), 1).otherwise(0)
    return messages.withColumn("_starts", starts).withColumn("turn_index", F.sum("_starts").over(w)).drop("_starts")


def turn_scores(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_index, user_messages, assistant_messages, user_chars, score)."""
    user = F.col("type") == "user"
    grouped = split_turns(messages).groupBy("conversation_id", "turn_index").agg(
        F.count_if(user).alias("user_messages"), F.count_if(~user).alias("assistant_messages"),
        F.coalesce(F.sum(F.when(user, F.length("content"))), F.lit(0)).cast("long").alias("user_chars"),
    )
    return grouped.withColumn("score", F.col("user_chars") * (1 + F.col("assistant_messages")))


def turn_edges(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_index, first_reply, last_reply): first and last substantial message of the assistant."""
    reply = (F.col("type") != "user") & (F.length("content") > SUBSTANTIAL)
    at, said = F.when(reply, F.col("sort_order")), F.when(reply, F.col("content"))
    return split_turns(messages).groupBy("conversation_id", "turn_index").agg(
        F.min_by(said, at).alias("first_reply"), F.max_by(said, at).alias("last_reply")
    )


def turn_places(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_index, place): the first and the last two turns are fixed, the others middle.

    Conversations of three turns or fewer have no middle.
    """
    turns = split_turns(messages).select("conversation_id", "turn_index").distinct()
    last = F.max("turn_index").over(Window.partitionBy("conversation_id"))
    fixed = (F.col("turn_index") == 0) | (F.col("turn_index") >= last - 1) | (last < 3)
    return turns.withColumn("place", F.when(fixed, "fixed").otherwise("middle"))


def islands(messages: DataFrame, flag: Column) -> DataFrame:
    """(conversation_id, island, flag, first_order, last_order, messages): runs of neighbours with equal flags."""
    w = Window.partitionBy("conversation_id").orderBy("sort_order")
    marked = messages.withColumn("_flag", flag)
    change = F.when(F.col("_flag").eqNullSafe(F.lag("_flag").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = marked.withColumn("_change", change).withColumn("island", F.sum("_change").over(w) - 1)
    return marked.groupBy("conversation_id", "island").agg(
        F.first("_flag").alias("flag"), F.min("sort_order").alias("first_order"), F.max("sort_order").alias("last_order"), F.count("*").alias("messages")
    )


def rendered_turns(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_index, score, confirmation, rendered, brief): each turn in full, and as one line."""
    message = F.struct("sort_order", "type", F.coalesce("content", F.lit("")).alias("content"))
    turns = split_turns(messages).groupBy("conversation_id", "turn_index").agg(F.array_sort(F.collect_list(message)).alias("m"))
    users = F.transform(F.filter("m", lambda x: x.type == "user"), lambda x: x.content)
    replies = F.transform(F.filter("m", lambda x: x.type != "user"), lambda x: F.struct(x.sort_order.alias("at"), x.content.alias("text")))
    turns = turns.select("conversation_id", "turn_index", users.alias("users"), replies.alias("replies"))
    long_ones = F.filter("replies", lambda r: F.length(r.text) > SUBSTANTIAL)
    any_one = F.slice(F.filter("replies", lambda r: r.text != ""), 1, 1)
    shown = F.when(F.size("long") > 1, F.array(F.col("long")[0], F.element_at("long", -1))).when(F.size("long") == 1, F.slice("long", 1, 1)).otherwise(any_one)
    turns = turns.withColumn("long", long_ones).withColumn("shown", shown)
    parts = F.concat(
        F.transform("users", lambda u: F.concat(F.lit("[User]:\n"), u)), F.transform("shown", lambda r: F.concat(F.lit("[Assistant]:\n"), r.text))
    )
    chars = F.aggregate("users", F.lit(0).cast("long"), lambda acc, u: acc + F.length(u))
    said = F.array_join("users", " ")
    line = trim_all(F.regexp_replace(said, "\n+", " "))
    preview = F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 80), F.lit("..."))).otherwise(line)
    return turns.withColumn("chars", chars).select(
        "conversation_id", "turn_index",
        F.when(F.col("chars") < CONFIRMATION, 0).otherwise(F.col("chars") * (1 + F.size("replies"))).cast("long").alias("score"),
        (F.col("chars") < CONFIRMATION).alias("confirmation"),
        F.array_join(parts, "\n\n").alias("rendered"),
        F.concat(F.lit("[确认] 用户: "), trim_all(said)).alias("short"),
        F.concat(F.lit("[跳过] 用户: "), preview).alias("brief"),
    )


def transcripts(messages: DataFrame, conversations: DataFrame, budget: int = 32_000) -> DataFrame:
    """(conversation_id, transcript, n_turns, n_selected): at most about ``budget`` characters of each conversation.

    Up to three turns are rendered whole and cut at the budget. Beyond that the first and the last two are never cut; of
    those between, the highest scores that still fit are rendered and the rest become one line. conversations: id,
    project_name, git_branch. One conversation's turns are folded together in one row.
    """
    turns = rendered_turns(meaningful(messages)).groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct("turn_index", "score", "confirmation", "rendered", "short", "brief"))).alias("t")
    )
    about = conversations.select(
        F.col("id").alias("conversation_id"),
        F.concat(F.lit("项目: "), F.coalesce("project_name", F.lit("null")), F.lit("\n分支: "), F.coalesce(F.when(F.col("git_branch") != "", F.col("git_branch")), F.lit("unknown")),
                 F.lit("\n\n--- 对话记录 ---\n\n")).alias("header"),
    )
    rows = turns.join(about, "conversation_id").withColumn("room", F.lit(budget) - F.length("header")).withColumn("n", F.size("t"))
    whole = F.substring(F.array_join(F.transform("t", lambda x: x.rendered), "\n\n"), F.lit(1), F.greatest("room", F.lit(0)))
    fixed = F.filter("t", lambda x: (x.turn_index == 0) | (x.turn_index >= F.col("n") - 2))
    middle = F.filter("t", lambda x: (x.turn_index > 0) & (x.turn_index < F.col("n") - 2))
    middle = F.transform(middle, lambda x: F.struct(
        (-x.score).alias("order"), x.turn_index.alias("turn_index"), F.when(x.confirmation, x.short).otherwise(x.rendered).alias("full"), x.brief.alias("brief")))
    rows = rows.withColumn("fixed", fixed).withColumn("middle", middle)
    used = F.aggregate("fixed", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x.rendered) + 2)
    rows = rows.withColumn("rest", F.greatest(F.col("room") - used, F.lit(0)))
    start = F.struct((F.size("middle") * SUMMARY_COST).cast("long").alias("used"), F.array().cast("array<bigint>").alias("picked"))

    def pick(acc: Column, x: Column) -> Column:
        cost = acc["used"] + F.length(x["full"]) + 2 - SUMMARY_COST
        more = F.struct(cost.cast("long").alias("used"), F.concat(acc["picked"], F.array(x["turn_index"].cast("long"))).alias("picked"))
        return F.when(cost > F.col("rest"), acc).otherwise(more)

    rows = rows.withColumn("picked", F.aggregate(F.array_sort("middle"), start, pick, lambda acc: acc["picked"]))
    by_turn = F.array_sort(F.transform("middle", lambda x: F.struct(x["turn_index"].alias("turn_index"), x["full"].alias("full"), x["brief"].alias("brief"))))
    lines = F.transform(by_turn, lambda x: F.when(F.array_contains("picked", x["turn_index"].cast("long")), x["full"]).otherwise(x["brief"]))
    pieces = F.concat(F.array(F.col("fixed")[0].rendered), lines, F.transform(F.slice("fixed", 2, 2), lambda x: x.rendered))
    packed = F.when(F.col("n") <= 3, whole).otherwise(F.array_join(pieces, "\n\n"))
    n_selected = F.when(F.col("n") <= 3, F.col("n")).otherwise(3 + F.size("picked"))
    return rows.select("conversation_id", F.concat("header", packed).alias("transcript"), F.col("n").cast("long").alias("n_turns"), n_selected.cast("long").alias("n_selected"))
