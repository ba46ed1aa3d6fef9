"""Logged conversations: snapshots that a longer log contains are dropped, the rest is rendered.

Every turn has a hash of its place and content; the rolling hash of the first turns is the XOR of theirs, so it can
be summed up in blocks of turns and no conversation, however long, is one task's whole work. A conversation whose hash equals
a proper prefix of another one is a snapshot of it and goes (anti join); of identical conversations the smallest id stays.
Prefixes are reduced to distinct hashes inside the tasks before they move: a first turn that all share is one row.

Rendering makes one row for every ``PART`` turn numbers, so no row grows with a conversation.

Defined cases: nulls in role or text are empty; rows that repeat id, turn, role and text count once; a null turn comes first;
turns of the same number are ordered by the hash of their content. A null ``conv_id`` is an id like any other, the smallest. Further
columns are not looked at. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodika.llm.common import whole
from episodika.session import cut_lineage

#: turn numbers in a block of running hashes, and in a rendered row
BLOCK, PART = 256, 64
START, END = "<|im_start|>", "<|im_end|>"


def _xor(column: str, over: Window | None = None) -> Column:
    value = F.bit_xor(column)
    return value.over(over) if over is not None else value


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = whole("role"), whole("text")
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64("turn", role, text).alias("h1"), F.xxhash64(F.lit("second"), "turn", role, text).alias("h2"),
        F.floor(F.col("turn") / PART).alias("part"),
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, part, n (turns so far), p1, p2 (their rolling hash), total: one row per distinct turn."""
    turns = _turns(conversations).select("conv_id", "turn", "part", "h1", "h2").distinct()
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns({"n": F.count(F.lit(1)).over(inside), "p1": _xor("h1", inside), "p2": _xor("h2", inside)})
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("bn"), _xor("h1").alias("b1"), _xor("h2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("bn").over(before), zero).alias("sn"),
        F.coalesce(_xor("b1", before), zero).alias("s1"), F.coalesce(_xor("b2", before), zero).alias("s2"), F.sum("bn").over(every).alias("total"),
    )
    joined = rows.join(blocks, rows["conv_id"].eqNullSafe(blocks["b_conv"]) & (rows["block"] == blocks["b_block"]))
    return joined.select(
        "conv_id", "turn", "part", (F.col("n") + F.col("sn")).alias("n"), F.col("p1").bitwiseXOR(F.col("s1")).alias("p1"),
        F.col("p2").bitwiseXOR(F.col("s2")).alias("p2"), "total",
    )


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, copies of the conversations that no longer one contains; ``rows`` from ``prefixes``."""
    ends = rows.where("n = total").groupBy("n", "p1", "p2").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = rows.where("n < total").select("n", "p1", "p2").distinct()
    return ends.join(proper, ["n", "p1", "p2"], "left_anti").select("conv_id", "copies", F.col("n").alias("turns"))


def _plain(text: Column) -> Column:
    """Marks of the format inside a text lose their bars."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, turns (of the conversation), copies, n_turns (of the part), rendered."""
    rows = cut_lineage(prefixes(conversations))
    best = maximal_conversations(rows).withColumnRenamed("conv_id", "m_conv")
    parts = rows.select("conv_id", "part").distinct()
    parts = parts.join(best, parts["conv_id"].eqNullSafe(best["m_conv"])).select(F.col("conv_id").alias("k_conv"), F.col("part").alias("k_part"), "turns", "copies")
    turns = _turns(conversations)
    kept = turns.join(parts, turns["conv_id"].eqNullSafe(parts["k_conv"]) & turns["part"].eqNullSafe(parts["k_part"]))
    shown = F.concat(F.lit(START), _plain(F.col("role")), F.lit("\n"), _plain(F.col("text")), F.lit(END + "\n"))
    said = kept.groupBy("k_conv", "k_part", "turns", "copies").agg(
        F.sort_array(F.collect_set(F.struct("turn", "h1", "h2", shown.alias("shown")))).alias("said")
    )
    return said.select(
        F.col("k_conv").alias("conv_id"), F.col("k_part").alias("part"), "turns", "copies", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda s: s["shown"]), "").alias("rendered"),
    )
