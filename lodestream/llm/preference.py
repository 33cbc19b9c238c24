"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of a pair is rendered once as the prompt; the turns
after it are the two completions. Each completion comes with the spans of its text
that are trained on (what the assistant says, with the end marker); all else is
masked. Turns are equal when role and text are.

Defined results: turns are ordered by number, then role, then text; null role and
text count as empty; a conversation without its partner is rendered as a prompt-less
completion with status ``unpaired``; a pair without any difference has two empty
completions and status ``identical``; rows without a conversation id belong to no
conversation. An empty table gives no rows; rows that repeat are turns that repeat.
A marker inside a text is broken by a space after ``<``, so no text can forge a turn.
Only the four columns are read, so names of others cannot clash. A pair is one row of the
result with its rendered texts, so its turns meet in one task: what a row may hold (2 GB)
bounds them, and only turns move, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers around a turn.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(TURN_START), F.lit("< |im_start|>")), F.lit(TURN_END), F.lit("< |im_end|>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(TURN_END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def spans(turns: Column) -> Column:
    """Character spans [from, to) of what is trained on, in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(_head(turn))
        end = begin + F.length(_body(turn))
        span = F.array(F.struct(begin.alias("from"), end.alias("to")))
        more = F.when(turn["role"] == TRAINED_ROLE, F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((end + 1).alias("at"), more.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def format_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row per pair. ``turns``: conv_id, turn, role, text; ``pair``: the pair of a row, ``chosen``: whether its conversation is the chosen one."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paired = (
        turns.where(F.col("conv_id").isNotNull())
        .select(pair.alias("pair_id"), chosen.alias("is_chosen"), F.col("conv_id").alias("conv_id"), turn.alias("turn"))
        .groupBy("pair_id")
        .agg(
            F.max(F.when(F.col("is_chosen"), F.col("conv_id"))).alias("chosen_id"),
            F.max(F.when(~F.col("is_chosen"), F.col("conv_id"))).alias("rejected_id"),
            F.array_sort(F.collect_list(F.when(F.col("is_chosen"), F.col("turn")))).alias("a"),
            F.array_sort(F.collect_list(F.when(~F.col("is_chosen"), F.col("turn")))).alias("b"),
        )
        .withColumn("n_prompt_turns", common_turns(F.col("a"), F.col("b")))
    )
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n_prompt_turns")))
    cut = paired.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", F.slice("a", F.lit(1), F.col("n_prompt_turns")).alias("p"), rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"))
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.when(F.col("chosen_id").isNull() | F.col("rejected_id").isNull(), "unpaired").when((F.size("a") == 0) & (F.size("b") == 0), "identical").otherwise("pair").alias("status"),
        "n_prompt_turns",
        render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        spans(F.col("a")).alias("chosen_spans"),
        render(F.col("b")).alias("rejected"),
        spans(F.col("b")).alias("rejected_spans"),
    )
