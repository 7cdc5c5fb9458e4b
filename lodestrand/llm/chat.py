"""Chat formatting with cumulative-snapshot collapse.

Logged conversations often come as snapshots: each holds all turns so far. A rolling hash over each conversation's turns
names its prefixes; a conversation whose hash is a proper prefix of another goes, as does the copy with the larger
conv_id of two that are equal. Both are anti-joins on (turns, hash), 128 bits, so no texts are shuffled to compare them. What is left is
rendered.

The turns of a conversation are ordered by turn (null first), role, text. conv_id and turn are integers or cast to one. Prefixes are of whole turns.
Result: (conv_id, n_turns, chat), chat being for each turn <|im_start|>role, newline, text, <|im_end|>, newline.
Defined results: rows without conv_id belong to no conversation and are left out. A null role or text
counts as empty; rows that then repeat another are one turn. The markers inside a text are set apart with a space after '<' so that a text can't forge a turn. Other columns take
no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import drop_written, written


def render(turns: Column) -> Column:
    def one(t: Column) -> Column:
        safe = lambda c: F.replace(F.replace(c, F.lit("<|im_"), F.lit("< |im_")), F.lit("|im_end|"), F.lit("|im_end |"))
        return F.concat(F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit("<|im_end|>\n"))

    return F.array_join(F.transform(turns, one), "")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, size): the rolling hash after each of a conversation's turns.

    The hash of a prefix is the exclusive or of its turns' hashes, each with its place, so that it rolls as a running aggregate.
    """
    turns = convs.select("conv_id", F.size("turns").alias("size"), F.posexplode("turns").alias("i", "t"))
    own = [F.xxhash64("i", "t.role", F.lit(salt), "t.text") for salt in (1, 2)]
    w = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "size", "i", own[0].alias("a"), own[1].alias("b")).select("conv_id", (F.col("i") + 1).alias("n"), F.bit_xor("a").over(w).alias("h1"), F.bit_xor("b").over(w).alias("h2"), "size")


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations that are no prefix of another."""
    convs = written(conversations(rows))
    all_ = written(prefixes(convs))
    whole = all_.where("n = size").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = all_.where("n < size").select("n", "h1", "h2").distinct()
    keep = written(whole.join(longer, ["n", "h1", "h2"], "left_anti").select("conv_id"))
    drop_written(all_)
    return convs.join(keep, "conv_id", "left_semi")


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat) of the maximal conversations of rows(conv_id, turn, role, text)."""
    return maximal(rows).select("conv_id", F.size("turns").alias("n_turns"), render(F.col("turns")).alias("chat"))
