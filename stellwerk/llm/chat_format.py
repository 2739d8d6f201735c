"""Chat formatting: cumulative-snapshot collapse, then rendering.

Logs often hold a conversation again and again, each time with a few more turns. A rolling hash over the
turns gives every prefix of a conversation 128 bits of its own. A conversation whose whole hash is the
hash of a proper prefix of a longer one is dropped (an anti-join against the proper prefixes); of equal
conversations the one with the least id stays (an anti-join against the others' ids). What stays is
maximal and is rendered as one text.

The prefix hash after a turn is, twice with 64 bits, the exclusive or of the hashes of (place, role, text) of the turns so
far: a running aggregate in a conversation. A conversation is one training text, so its turns meet in one row; groups
of conversations that share a beginning never meet: they only count in aggregates and equi-joins.

Defined results: turns are ordered by turn, then role and text; turns that repeat turn, role and text are
one turn; null role or text counts as empty; rows with a null conv_id are left out; empty tables give
empty results; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.common import stored


def rendered(turns: Column) -> Column:
    """<|role|>, a line break, the text and a line break for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def hashed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), role, text, and a, b: the hash of the conversation up to this turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    again = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    rows = rows.withColumn("again", again).filter(~F.col("again")).withColumn("place", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "conv_id", "place", "role", "text",
        F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far).alias("a"), F.bit_xor(F.xxhash64("text", "role", "place", F.lit(7))).over(so_far).alias("b"),
    )


def collapsed(turns: DataFrame, **columns: str) -> DataFrame:
    """conv_id, turns, n_turns, prefix (whole hash), kept for each conversation."""
    turn = F.struct("place", "role", "text", F.struct("a", "b").alias("p"))
    whole = hashed_turns(turns, **columns).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn("n_turns", F.size("turns").cast("long"))
    whole = stored(whole.withColumn("prefix", F.element_at("turns", -1)["p"]), "conversations")
    proper = whole.select(F.explode(F.slice("turns.p", 1, F.greatest(F.size("turns") - 1, F.lit(0)))).alias("p")).distinct()
    longest = whole.select("conv_id", "prefix").join(proper, F.col("prefix") == F.col("p"), "left_anti")
    first = longest.groupBy("prefix").agg(F.min("conv_id").alias("k_id"))
    return whole.join(first.select("k_id"), F.col("conv_id") == F.col("k_id"), "left").withColumn("kept", F.col("k_id").isNotNull()).drop("k_id")


def formatted(turns: DataFrame, **columns: str) -> DataFrame:
    """conv_id, n_turns and text of the conversations that are no prefix of another."""
    return collapsed(turns, **columns).filter("kept").select("conv_id", "n_turns", rendered(F.col("turns")).alias("text"))
