"""Preference formatting of paired conversations.

The longest common turn prefix of the chosen and the rejected conversation is rendered once, as the prompt;
what follows in each is its completion. A completion's mask lists the spans of characters, from 0, that
count for the loss: the assistant's texts with their end marks.

Defined cases: turns without a conversation id belong to no conversation; turns stand by turn number (null
last), then role, then text, so repeated rows are repeated turns; a null role is "unknown", a null text
empty; a mark inside a text is broken by a space so that it can't end the turn; identical conversations
have empty completions and masks; a conversation without a partner gives a row whose other side is null
and whose prompt is empty; an empty table gives an empty table; other columns are not read; a
conversation, however long, is one row and must fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns that mask_of() takes together.
BLOCK = 256


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    said = F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("turns"))


def safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit("\n"), safe(turn["text"]), F.lit(CLOSE + "\n"))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns: Column) -> Column:
    """Spans start-end, comma-joined, of the assistant's texts and end marks.

    Turns are taken in blocks of BLOCK: the sums of blocks tell where each one starts, so a conversation of n
    turns costs about n * BLOCK steps, not n squared.
    """
    long = lambda c: c.cast("long")
    size = lambda turn: long(F.length(rendered(turn)))
    nothing = F.array().cast("array<string>")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int"))), lambda b: F.slice(turns, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, turn: n + size(turn)))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))

    def spans(block: Column, start: Column) -> Column:
        def add(done: Column, turn: Column) -> Column:
            text_at = done["at"] + F.length(F.lit(OPEN)) + F.length(safe(turn["role"])) + 1
            span = F.concat_ws("-", text_at.cast("string"), (done["at"] + size(turn) - 1).cast("string"))
            own = F.when(turn["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
            return F.struct(long(done["at"] + size(turn)).alias("at"), own.alias("spans"))

        return F.aggregate(block, F.struct(start.alias("at"), nothing.alias("spans")), add, lambda done: done["spans"])

    return F.array_join(F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), spans)), ",")


def prefix_length(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    alike = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(alike, False)
    return F.when(first == 0, least).otherwise(first - 1).cast("int")


def neighbours(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversation 2k is chosen over 2k + 1."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    pair = F.shiftright("conv_id", 1).alias("pair_id")
    side = lambda n: F.max(F.when(F.pmod("conv_id", F.lit(2)) == n, F.col("conv_id")))
    return ids.groupBy(pair).agg(side(0).alias("chosen_id"), side(1).alias("rejected_id"))


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each pair: prompt, completions and masks."""
    talks = conversations(turns)
    chosen = talks.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    rejected = talks.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    both = pairs.join(chosen, "chosen_id", "left").join(rejected, "rejected_id", "left")
    both = both.withColumn("n_prompt_turns", F.coalesce(prefix_length(F.col("c"), F.col("r")), F.lit(0)))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    return both.withColumns({"c": rest("c"), "r": rest("r"), "p": F.slice("c", 1, F.col("n_prompt_turns"))}).select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", F.coalesce(text_of(F.col("p")), F.lit("")).alias("prompt"),
        text_of(F.col("c")).alias("chosen"), text_of(F.col("r")).alias("rejected"), mask_of(F.col("c")).alias("chosen_mask"), mask_of(F.col("r")).alias("rejected_mask"),
    )
