"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Texts are equal when they are identical after every run of white space became one space.

* A group of copies meets only in an aggregate (minimum and count, combined before the shuffle)
  and in an equi-join with one row on the other side, whose hot partitions AQE can split.
* Every member of a group is compared with the text of the row that stays. Rows that share a hash
  but not the text (collisions) are grouped again by the text itself.

Defined results: null text counts as empty; a null id never stays before a real one, and stays
only if its group has no other; rows that repeat both id and text are one document: their verdict
is the same, and `deduplicate` returns the first of them by all columns; an empty table gives an empty result; extra
columns are carried through `deduplicate` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import first_of, hash_128, one_space, stored, text_of, unused


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return hash_128(text)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and hash for every row of docs."""
    norm = one_space(text_of(text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), norm.alias("norm")).withColumn("hash", hash_of(F.col("norm")))
    groups = rows.groupBy("hash").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    #: Both joins read the same columns dealt out by the hash alone, so whole texts are shuffled once; no id of a group is below its least.
    #: The heads are dealt out again, few as they are, so that the join before may split a hot group.
    head = (F.col("doc_id") <= F.col("g_id")) | F.col("g_id").isNull()
    stays = (
        rows.join(groups.filter("n > 1").select(F.col("hash").alias("g_hash"), F.col("keep_id").alias("g_id")), (F.col("hash") == F.col("g_hash")) & head)
        .select("hash", "norm").repartition("hash").groupBy(F.col("hash").alias("s_hash")).agg(F.min("norm").alias("stays"))
    )
    heads = groups.join(stays, groups["hash"] == stays["s_hash"], "left").select(F.col("hash").alias("h_hash"), "keep_id", "n", "stays")
    same = F.col("n").eqNullSafe(1) | (F.col("norm") == F.col("stays"))
    checked = stored(
        rows.join(heads, F.col("hash") == F.col("h_hash"))
        .select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", F.col("n").alias("group_size"), F.when(~same, F.col("norm")).alias("odd")),
        "exact-classes",
    )
    if not checked.filter(F.col("odd").isNotNull()).isEmpty():
        checked = _split_collisions(checked)
    return checked.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "hash"
    )


def _split_collisions(checked: DataFrame) -> DataFrame:
    """Rows whose text differs from the one that stays form groups by their text; the others' size shrinks."""
    odd = checked.filter(F.col("odd").isNotNull())
    by_text = odd.groupBy(F.col("hash").alias("o_hash"), F.col("odd").alias("o_text")).agg(F.min("doc_id").alias("o_id"), F.count(F.lit(1)).alias("o_n"))
    by_hash = odd.groupBy(F.col("hash").alias("l_hash")).agg(F.count(F.lit(1)).alias("left"))
    return (
        checked.join(by_text, (F.col("hash") == F.col("o_hash")) & (F.col("odd") == F.col("o_text")), "left")
        .join(by_hash, F.col("hash") == F.col("l_hash"), "left")
        .withColumn("keep_id", F.when(F.col("odd").isNull(), F.col("keep_id")).otherwise(F.col("o_id")))
        .withColumn("group_size", F.when(F.col("odd").isNotNull(), F.col("o_n")).otherwise(F.col("group_size") - F.coalesce("left", F.lit(0))))
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text, the first by all columns."""
    kept = classes(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256").distinct()
    sha, nth, k_id, k_sha = unused(docs, "sha", "nth", "k_id", "k_sha")
    rows = docs.withColumn(sha, F.sha2(one_space(text_of(text_col)), 256)).join(kept.toDF(k_id, k_sha), (F.col(sha) == F.col(k_sha)) & F.col(f"`{id_col}`").eqNullSafe(F.col(k_id)))
    return first_of(rows, [sha, k_id], docs.columns, nth)
