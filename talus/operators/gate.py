"""Experience gate: lexical signals of a conversation, a prefilter, a score over judged dimensions, and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import CJK, SPACE, blank, dense_length, matches, trim_all
from talus.operators.turns import meaningful


@dataclass(frozen=True)
class Lexicon:
    """The patterns of each signal, English and Chinese, any case; the white space that lengths leave out, and that ends lose."""

    low_info: str = r"(?i)^(?:好|好的|继续|确认|ok|okay|yes|go on|继续吧|可以)$"
    problem: str = (
        r"(?i)(?:fail|failed|error|exception|bug|fix|broken|timeout|refactor|implement|migrate|optimi[sz]e|choose|decide|tradeoff|root cause|need"
        r"|问题|失败|报错|异常|修复|实现|迁移|优化|选择|决策|取舍|原因|目标|约束)"
    )
    error: str = r"(?i)(?:error|exception|stack trace|traceback|ECONN|ETIMEDOUT|ENOENT|EADDRINUSE|TypeError|ReferenceError|SyntaxError|失败|报错|异常|错误码)"
    code: str = r"(?i)(?:```|[\w.-]+/[\w./-]+\.(?:ts|tsx|js|jsx|json|md|py|sql)|\b[A-Za-z_$][\w$]+\(|diff --git|SELECT\s+.+\s+FROM)"
    process: str = r"(?i)(?:inspect|compared?|try|attempt|debug|verify|verified|validated|reproduce|root cause|investigate|found|排查|尝试|验证|复现|分析|比较|定位|发现)"
    decision: str = r"(?i)(?:choose|decide|decision|tradeoff|instead|because|reason|therefore|方案|选择|决策|取舍|因为|所以|最终|改为)"
    outcome: str = (
        r"(?i)(?:fixed|passed|complete|resolved|implemented|verified|blocked|reverted|resolution|result|makes? .+ clear|audit clear"
        r"|修复|通过|完成|解决|验证通过|结论|失败原因)"
    )
    reuse: str = r"(?i)(?:pattern|reusable|reuse|pitfall|lesson|next time|future|similar|principle|模式|复用|踩坑|经验|原则|类似|以后)"
    space: str = SPACE
    edge: str = SPACE


DIMENSIONS = ("problem_clarity", "process_depth", "decision_value", "outcome_closure", "reuse_potential")


def message_texts(messages: DataFrame) -> DataFrame:
    """(conversation_id, text): all message texts of a conversation in order, one to a line."""
    said = F.struct("sort_order", F.coalesce("content", F.lit("")).alias("content"))
    return messages.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.content), "\n").alias("text")
    )


def signals(messages: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """One row per conversation with the ten signals. messages may lack has_code and has_tool_use.

    Messages that only call a tool, without text, don't count: a conversation of such alone has no row.
    A message whose content is null is no effective turn; an empty one is.
    """
    for flag in ("has_code", "has_tool_use"):
        if flag not in messages.columns:
            messages = messages.withColumn(flag, F.lit(False))
    messages = meaningful(messages)
    said = F.struct("sort_order", F.coalesce("content", F.lit("")).alias("content"))
    effective = (F.col("type") == "user") & ~matches(trim_all(F.col("content"), lexicon.edge), lexicon.low_info)
    rows = messages.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.content), "\n").alias("text"),
        F.count_if(effective).alias("effective_turns"),
        F.coalesce(F.bool_or(F.coalesce("has_code", F.lit(False)) | F.coalesce("has_tool_use", F.lit(False))), F.lit(False)).alias("marked"),
    )
    text = F.col("text")
    rows = rows.select(
        "conversation_id", "effective_turns", dense_length(text, lexicon.space).cast("long").alias("content_chars"),
        matches(text, lexicon.problem).alias("has_problem_signal"), matches(text, lexicon.error).alias("has_error_signal"),
        (F.col("marked") | matches(text, lexicon.code)).alias("has_code_signal"), matches(text, lexicon.process).alias("has_process_signal"),
        matches(text, lexicon.decision).alias("has_decision_signal"), matches(text, lexicon.outcome).alias("has_outcome_signal"),
        matches(text, lexicon.reuse).alias("has_reuse_signal"),
    )
    strong = (
        (F.col("effective_turns") == 1) & (F.col("content_chars") >= 120) & F.col("has_problem_signal") & F.col("has_decision_signal")
        & (F.col("has_outcome_signal") | F.col("has_reuse_signal"))
    )
    return rows.withColumn("has_strong_single_turn_signal", strong)


def missing_signals() -> Column:
    names = ("problem", "outcome", "reuse")
    return F.array_compact(F.array(*(F.when(~F.col(f"has_{n}_signal"), F.lit(n)) for n in names)))


def prefilter(rows: DataFrame) -> DataFrame:
    """rows with prefilter_reason (null: passes) and missing_signals. The first rule that holds decides."""
    strong = F.col("has_strong_single_turn_signal")
    thin = (F.col("content_chars") < 800) & ~F.col("has_error_signal") & ~F.col("has_code_signal") & ~strong
    reason = (
        F.when(thin, "low-signal")
        .when(~F.col("has_problem_signal"), "missing-problem")
        .when((F.col("effective_turns") < 2) & ~strong, "single-turn-low-density")
        .when(~F.col("has_outcome_signal") & ~F.col("has_reuse_signal"), "no-reusable-experience")
    )
    return rows.withColumn("prefilter_reason", reason).withColumn("missing_signals", missing_signals())


def combine(rows: DataFrame) -> DataFrame:
    """rows (signals and DIMENSIONS) with score, decision, confidence and reason. A dimension that is null gives no points."""
    def points(flag: Column, n: int) -> Column:
        return F.when(flag, n).otherwise(0)

    s = {n: F.col(f"has_{n}_signal") for n in ("error", "code", "process", "decision", "outcome", "reuse")}
    bonus = F.least(F.lit(10), points(s["error"], 3) + points(s["code"], 2) + points(s["process"], 2) + points(s["decision"], 3))
    alone = (F.col("effective_turns") < 2) & ~F.col("has_strong_single_turn_signal")
    penalty = points(~s["outcome"], 20) + points(~s["reuse"], 20) + points(~s["process"] & ~s["decision"], 30) + points(alone, 25)
    judged = sum((F.coalesce(d, F.lit(0)) for d in DIMENSIONS), F.lit(0))  # least() would skip a null and leave 100
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (judged + bonus - penalty).cast("double")))
    closed = (F.col("outcome_closure") >= 14) & (F.col("reuse_potential") >= 14)
    decision = (
        F.when(~s["outcome"], "reject").when((F.col("score") >= 75) | ((F.col("score") >= 65) & closed), "accept")
        .when(F.col("score") >= 55, "borderline").otherwise("reject")
    )
    reason = F.when(~s["outcome"], "critical-signal-missing").when(F.col("decision") == "accept", "experience-threshold-met").otherwise("experience-threshold-not-met")
    return (
        rows.withColumn("score", score).withColumn("decision", decision)
        .withColumn("confidence", F.when(s["outcome"], 0.75).otherwise(0.85)).withColumn("reason", reason)
        .withColumn("missing_signals", missing_signals())
    )


def decide(messages: DataFrame, dimensions: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(conversation_id, decision, score, confidence, reason, missing_signals): the whole gate.

    dimensions: conversation_id and DIMENSIONS, needed only for conversations that pass the prefilter.
    """
    rows = prefilter(signals(messages, lexicon)).join(dimensions, "conversation_id", "left").fillna(0, list(DIMENSIONS))
    scored = combine(rows)
    stopped = F.col("prefilter_reason").isNotNull()
    return scored.select(
        "conversation_id",
        F.when(stopped, "reject").otherwise(F.col("decision")).alias("decision"), F.when(stopped, 0.0).otherwise(F.col("score")).alias("score"),
        F.when(stopped, 0.9).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("prefilter_reason", "reason").alias("reason"), "missing_signals",
    )


def structured_gaps(memories: DataFrame) -> DataFrame:
    """memories with missing: what a structured memory lacks for its outcome type; an empty array is valid."""
    def text(name: str) -> Column:
        return ~blank(F.col(name))

    def items(name: str) -> Column:
        return F.coalesce(F.exists(name, lambda x: ~blank(x)), F.lit(False))

    summary = F.coalesce(trim_all(F.col("summary")), F.lit(""))
    meaning = dense_length(summary) >= F.when(summary.rlike(CJK), 18).otherwise(24)
    core = text("root_cause") | text("resolution") | items("decisions") | items("reusable_patterns") | items("pitfalls")
    kind = F.coalesce("outcome_type", F.lit(""))
    tests = (
        (~meaning, "summary"), (~core, "experience_core"),
        ((kind == "fix") & ~text("root_cause") & ~text("resolution"), "root_cause_or_resolution"),
        ((kind == "pitfall") & (~items("pitfalls") | (~text("resolution") & ~items("reusable_patterns"))), "pitfalls_and_resolution_or_pattern"),
        ((kind == "decision") & ~items("decisions"), "decisions"), ((kind == "pattern") & ~items("reusable_patterns"), "reusable_patterns"),
    )
    return memories.withColumn("missing", F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests))))


def mark_filtered(conversations: DataFrame, decisions: DataFrame) -> DataFrame:
    """conversations with status, score, reason and details of those that the gate didn't accept."""
    fields = [f.name for f in decisions.schema if f.name != "conversation_id"]
    bad = decisions.where("decision <> 'accept'").select(
        F.col("conversation_id").alias("_id"), F.col("score").alias("_score"), F.col("reason").alias("_reason"), F.to_json(F.struct(*fields)).alias("_details")
    )
    out = conversations.join(bad, conversations.id == bad["_id"], "left")
    hit = F.col("_id").isNotNull()
    new = {"status": F.lit("filtered"), "experience_score": F.col("_score"), "experience_gate_reason": F.col("_reason"), "experience_gate_details": F.col("_details")}
    return out.select(*(F.when(hit, new[c]).otherwise(conversations[c]).alias(c) if c in new else conversations[c] for c in conversations.columns))


def evaluation(rows: DataFrame) -> DataFrame:
    """One row over (decision, expected): total, passed, failed, pass_rate, false_accepts, false_rejects."""
    right = F.col("decision") == F.col("expected")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(right).alias("passed"), F.count_if(~right).alias("failed"),
        F.coalesce(F.count_if(right) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("pass_rate"),
        F.count_if((F.col("decision") == "accept") & (F.col("expected") != "accept")).alias("false_accepts"), F.count_if((F.col("decision") != "accept") & (F.col("expected") == "accept")).alias("false_rejects"),
    )


def failures(evaluated: DataFrame) -> DataFrame:
    """The samples of ``evaluate`` that were decided otherwise than expected, by id."""
    return evaluated.where(~F.col("decision").eqNullSafe(F.col("expected"))).orderBy("id")


def load_samples(spark, path: str) -> DataFrame:
    """Labelled samples of a JSON file, an array or an object with ``samples``: id, label, expected, messages, DIMENSIONS."""
    message = "struct<type:string,content:string,has_tool_use:boolean,has_code:boolean>"
    sample = f"struct<id:string,label:string,expected_decision:string,messages:array<{message}>,judge_dimensions:struct<{','.join(f'{d}:double' for d in DIMENSIONS)}>>"
    rows = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"struct<samples:array<{sample}>>")["samples"], F.from_json("value", f"array<{sample}>"))
    rows = rows.select(F.explode(listed).alias("s"))
    return rows.select("s.id", "s.label", F.col("s.expected_decision").alias("expected"), "s.messages", *(F.coalesce(F.col(f"s.judge_dimensions.{d}"), F.lit(0.0)).alias(d) for d in DIMENSIONS))


def evaluate(samples: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """The gate's decision on each sample: id, label, expected, decision, score, reason."""
    messages = samples.select(F.col("id").alias("conversation_id"), F.posexplode("messages").alias("sort_order", "m")).select("conversation_id", "sort_order", "m.*")
    decided = decide(messages, samples.select(F.col("id").alias("conversation_id"), *DIMENSIONS), lexicon)
    return samples.select("id", "label", "expected").join(decided.withColumnRenamed("conversation_id", "id"), "id")
