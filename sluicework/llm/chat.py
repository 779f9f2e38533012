"""Collapse of cumulative conversation logs, and rendering; DataFrame functions only.

A log that writes the whole conversation again after every turn holds each conversation many
times, as prefixes of its last form. Every turn gets a rolling hash of the turns up to it (the xor
of hashes of place, role and text, 128 bits). A conversation whose full hash is another one's
proper prefix goes, by an anti-join on hashes; of equal conversations the smallest conv_id stays.
Turns are in the order of turn, role and text; a turn's place in that order counts, not its number.

The hashes never gather a conversation; only the rendering of what is left does, since a
conversation is one text.

Defined cases: a null conv_id is a conversation; null turns sort first; a null role or text differs
from an empty one in comparing and is rendered as empty; repeated rows of a turn are turns of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _hash(seed: int) -> Column:
    text, role = F.col("text"), F.col("role")
    return F.xxhash64(F.lit(seed), F.col("place"), role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit("")))


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """Per turn: conv_id, place (from 1), role, text, p1 and p2 (hash of the turns so far), longer (more follow)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .withColumn("place", F.row_number().over(order))
        .withColumns({"h1": _hash(11), "h2": _hash(29)})
        .withColumns({"p1": F.bit_xor("h1").over(so_far), "p2": F.bit_xor("h2").over(so_far), "longer": F.lead("place").over(order).isNotNull()})
        .select("conv_id", "place", "role", "text", "p1", "p2", "longer")
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """Conversations that no other one goes on from: conv_id, n_turns, n_copies."""
    turns = turn_prefixes(conversations).select("conv_id", "place", "p1", "p2", "longer")
    whole = (
        turns.where(~F.col("longer")).groupBy("place", "p1", "p2")
        .agg(F.min(F.struct("conv_id")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    )
    prefixes = turns.where("longer").select("place", "p1", "p2").distinct()
    return whole.join(prefixes, ["place", "p1", "p2"], "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), F.col("place").cast("long").alias("n_turns"), "n_copies"
    )


def render(conversations: DataFrame) -> DataFrame:
    """The maximal conversations as text: conv_id, n_turns, n_copies, text."""
    kept = maximal(conversations).withColumnRenamed("conv_id", "kept_id")
    piece = F.concat(
        F.lit("<|im_start|>"), F.coalesce(F.col("role"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("<|im_end|>\n")
    )
    turns = turn_prefixes(conversations).select("conv_id", "place", piece.alias("piece"))
    return (
        turns.join(kept, turns.conv_id.eqNullSafe(kept.kept_id))
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("turns"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"))
    )
