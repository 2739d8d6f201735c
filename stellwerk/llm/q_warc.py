"""The query of WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import warc
from stellwerk.llm.common import table

#: Pages carry no time of capture: it is this moment and as many seconds more as the id has, modulo 100 million.
EPOCH = "2024-01-01"


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives, with its place in the history of its URL."""
    pages = table(spark, sf_dir, "pages")
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000)).cast("int")
    captured = F.date_format(F.timestamp_add("SECOND", seconds, F.lit(EPOCH).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = warc.histories(warc.runs(spark, warc.write(pages, captured=captured)))
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url_key", "captured", "nth")


QUERIES = {"op12_warc": op12_warc}
ORACLE_SQL = {
    "op12_warc": r"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 100000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM pages),
        d AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS stays,
                     regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)', ['host', 'rest']) AS u FROM p),
        k AS (SELECT *, CASE WHEN u.host = '' AND u.rest = '' THEN url ELSE array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || CASE u.rest WHEN '' THEN '/' ELSE u.rest END END AS url_key FROM d)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < stays THEN stays END AS refers_to, url_key, captured,
               row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) AS nth
        FROM k
    """,
}
