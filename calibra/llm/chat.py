"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once after each turn. Rolling hashes over each conversation's turns identify every
prefix; a conversation whose own hash is a shorter prefix's hash elsewhere is dropped by an anti-join, of equal ones
the least conv_id stays, and what remains is rendered. Rows without conv_id belong to no conversation and are
dropped; a null role or text counts as empty; a null turn comes first; turns with equal numbers are ordered by a hash
of their contents, and equal rows count as turns each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def turns(logs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, k1, k2): k1 and k2 identify a turn's contents."""
    t = logs.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return t.withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit("2"), "text", "role")})


def prefixes(logs: DataFrame) -> DataFrame:
    """(conv_id, n, n_turns, p1, p2): a rolling hash of each conversation's first n turns, in 128 bits.

    Each turn is hashed with its place, so the exclusive or of these depends on their order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "k1", "k2")
    placed = turns(logs).select("conv_id", "turn", "k1", "k2").select("conv_id", "turn", "k1", "k2", F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    roll = lambda *c: F.bit_xor(F.xxhash64(*c)).over(so_far)
    return placed.select("conv_id", F.col("n").cast("long").alias("n"), "n_turns", roll("n", "k1", "k2").alias("p1"), roll("k2", "n", "k1").alias("p2"))


def maximal(logs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one starts with."""
    p = prefixes(logs)
    ends = p.where("n = n_turns").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = p.where("n < n_turns").select("n", "p1", "p2").distinct()
    return ends.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(logs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): each maximal conversation in one string, a turn after the other."""
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    cells = turns(logs).select("conv_id", F.struct("turn", "k1", "k2", piece.alias("piece")).alias("cell"))
    kept = cells.join(maximal(logs), "conv_id")
    return kept.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["piece"]), "").alias("text"))
