"""The query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import mixing
from stellwerk.llm.common import table


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken")
    )


QUERIES = {"op5_source_mixing": op5_source_mixing}
ORACLE_SQL = {
    "op5_source_mixing": r"""
        WITH x AS (
            SELECT doc_id, source, length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D!-/0-9:-@\[-`{-~]+', '', 'g')) AS letters
            FROM documents),
        q AS (
            SELECT doc_id, source, size,
                   greatest(0.05::DOUBLE, least(1::DOUBLE, letters / greatest(chars, 1) / 0.75::DOUBLE)
                   * greatest(0::DOUBLE, 1::DOUBLE - 3::DOUBLE * greatest(0::DOUBLE, greatest(0, chars - letters - size) / greatest(chars, 1) - 0.05::DOUBLE))
                   * CASE WHEN letters / greatest(size, 1) BETWEEN 2::DOUBLE AND 25::DOUBLE THEN 1::DOUBLE ELSE 0.5::DOUBLE END) AS weight
            FROM x),
        d AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / weight AS key FROM q),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
        w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
        l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT *, cap / weight <= level AS stops FROM l),
        g AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE)
                     ELSE weight * (SELECT arg_min(level, (cap / weight, rank)) FROM f WHERE NOT stops) END AS target FROM f),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
        p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(size * (epochs + CASE WHEN start + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM p
    """,
}
