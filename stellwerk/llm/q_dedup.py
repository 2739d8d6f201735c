"""Queries of the dedup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import bag_minhash, exact_dedup
from stellwerk.llm.common import table


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents")).drop("hash")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the least id with the same words, the least id of its class, whether it stays."""
    found = bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "rep_id", "cluster_id", "kept")


QUERIES = {"op2_exact_dedup": op2_exact_dedup, "op3_minhash_near_dedup": op3_minhash_near_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
}
