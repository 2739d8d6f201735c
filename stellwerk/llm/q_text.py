"""The queries of chat formatting and line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import chat_format, line_dedup
from stellwerk.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, whether it stays, and its text if it does."""
    found = chat_format.collapsed(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "n_turns", "kept", F.when(F.col("kept"), chat_format.rendered(F.col("turns"))).alias("text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text without the lines that occur on five sites or more; a source is a site."""
    found = line_dedup.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__clean").alias("clean_text"))


QUERIES = {"op1_chat_format": op1_chat_format, "op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                     string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') OVER w AS prefix,
                     md5(string_agg(md5(role) || md5(text), '') OVER w) AS hash
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        whole AS (SELECT conv_id, n_turns, prefix, hash FROM p WHERE n = n_turns),
        top AS (SELECT min(conv_id) AS conv_id FROM whole WHERE hash NOT IN (SELECT hash FROM p WHERE n < n_turns) GROUP BY hash)
        SELECT w.conv_id, w.n_turns, top.conv_id IS NOT NULL AS kept, CASE WHEN top.conv_id IS NOT NULL THEN w.prefix END AS text
        FROM whole w LEFT JOIN top ON w.conv_id = top.conv_id
    """,
    "op4_line_dedup": r"""
        WITH l AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        e AS (SELECT r, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM l),
        b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
        bad AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5),
        k AS (SELECT r, count(*) AS n_lines, count(bad.bare) AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE bad.bare IS NULL), '') AS clean_text
              FROM b LEFT JOIN bad ON b.bare = bad.bare GROUP BY r)
        SELECT l.doc_id, n_lines, n_removed, clean_text FROM k JOIN l ON k.r = l.r
    """,
}
