"""Labels for the classifiers: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import fold_of


def held_out(id_col: str = "doc_id") -> Column:
    """One row of three, by crc32 of the id, is never learned from."""
    return F.coalesce(fold_of(F.col(id_col), 3) == 1, F.lit(False))


def sampled(labels: DataFrame, label: str, most: int, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """id, label of at most `most` learnable documents, those with the least hash of the id.

    A document with several labels counts as 1 if any of them is 1; null labels and null ids are left out.
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def one_each(features: DataFrame, chosen: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """label, doc_id and features of the chosen documents (id, label): one row of each id, the least, so no more rows than were chosen."""
    found = features.join(F.broadcast(chosen.withColumnRenamed("id", "l_id")), F.col("doc_id") == F.col("l_id"))
    return found.groupBy("doc_id").agg(F.min(F.struct("label", *names)).alias("x")).select("x.label", "doc_id", *[F.col(f"x.{c}") for c in names])
