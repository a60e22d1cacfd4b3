"""Interview transcripts as windows over (conversation, turn).

Interviewer turns are ``assistant`` rows, interviewee answers are
``user`` rows, one conversation is one topic. Every operator is a window
partitioned by conversation, so one conversation is the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------
FOLLOWUP_PREFIXES = ["what", "how", "why", "could", "tell me"]
FALLBACK_QUESTION = "Could you please elaborate further on that?"
STOP_ANSWERS = ["no", "nothing", "no more", "that's all", "done"]
MAX_FOLLOWUPS = 3
SPEAKER = {"assistant": "Interviewer", "user": "User"}
PROMPT_TEMPLATE = (
    "You are a highly focused and inquisitive interviewer. Follow these guidelines:\n"
    "  - Your follow-up question must be strictly about the current topic: %s\n"
    "  - Ask open-ended questions that require more than a yes/no answer.\n"
    "  - Bounce back on specific details from the aggregated response by asking for examples, "
    "clarifications, or further elaboration.\n"
    "  - Remain strictly focused on the topic; do not deviate to unrelated issues.\n\n"
    "Conversation History:\n%s\n\n"
    "Current aggregated response for '%s': '%s'\n\n"
    "Based on the above, generate a specific follow-up question to gain more in-depth insight."
)
# --------------------------------------------------------------------------


def _by_conv() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def speaker_line(role: Column, text: Column) -> Column:
    who = F.when(role == "assistant", F.lit(SPEAKER["assistant"])).when(role == "user", F.lit(SPEAKER["user"]))
    return F.concat(who, F.lit(": "), text)


def running_history(turns: DataFrame) -> DataFrame:
    """Per speaking turn: its labelled line and the length of the history
    up to and including it (lines joined by newlines). Linear in the
    transcript: the history text itself is the prefix of ``transcript``."""
    t = turns.filter(F.col("role").isin("assistant", "user")).withColumn(
        "line", speaker_line(F.col("role"), F.col("text")))
    w = _by_conv().rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "turn", "line",
                    (F.sum(F.length("line") + 1).over(w) - 1).alias("history_chars"))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): all labelled lines in turn order."""
    t = turns.filter(F.col("role").isin("assistant", "user")).withColumn(
        "line", speaker_line(F.col("role"), F.col("text")))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n").alias("transcript"))


def validate_followup(text: Column) -> Column:
    """Keep a question that starts with one of the prefixes (prefix, not
    word: 'whatever' passes), else the fixed fallback question."""
    t = F.lower(F.trim(text))
    ok = None
    for p in FOLLOWUP_PREFIXES:
        c = t.startswith(p)
        ok = c if ok is None else ok | c
    return F.when(ok, F.trim(text)).otherwise(F.lit(FALLBACK_QUESTION))


def is_stop(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*STOP_ANSWERS)


def kept_answers(turns: DataFrame) -> DataFrame:
    """User answers that enter the topic aggregate: before the first stop
    answer (which is not kept) and at most 1 + MAX_FOLLOWUPS of them."""
    u = turns.filter(F.col("role") == "user")
    # first stop per conversation is an aggregate; the cap is a constant
    # row_number limit (WindowGroupLimit), so no conversation is sorted whole
    first_stop = u.filter(is_stop(F.col("text"))).groupBy("conv_id").agg(F.min("turn").alias("_stop"))
    u = (u.join(first_stop, "conv_id", "left")
         .filter(F.col("_stop").isNull() | (F.col("turn") < F.col("_stop"))))
    u = u.withColumn("k", F.row_number().over(_by_conv())).filter(F.col("k") <= 1 + MAX_FOLLOWUPS)
    return u.select("conv_id", "turn", F.trim("text").alias("answer"), "k")


def aggregate_topic(turns: DataFrame) -> DataFrame:
    """(conv_id, n_answers, aggregate): kept answers joined by one space."""
    k = kept_answers(turns)
    return k.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "answer"))),
                                 lambda s: s["answer"]), " ").alias("aggregate"))


def render_prompt(turns: DataFrame) -> DataFrame:
    """Follow-up prompt per topic from the full history and the aggregate."""
    a = aggregate_topic(turns)
    h = transcript(turns)
    return a.join(h, "conv_id").select(
        "conv_id", F.format_string(PROMPT_TEMPLATE, F.col("conv_id").cast("string"), F.col("transcript"),
                                   F.col("conv_id").cast("string"), F.col("aggregate")).alias("prompt"))
