"""Line dedup by distinct-site spread, in DataFrame operations only.

A line is boilerplate if it occurs on at least `sites` different sites. Per line hash (128 bits) a
HyperLogLog sketch of the sites is built in the map tasks and merged by the aggregation; lines whose
estimate is far from the threshold are decided by it, lines near it get an exact distinct count. Rows
of the spread table exist only for lines that could matter; documents lose their boilerplate lines by
place.

Lines are compared without white space at their ends; blank lines are never boilerplate and stay.
Defined results: null text counts as empty; a null site is a site of its own; a null id is carried; rows
that repeat id and text are treated alike and all stay; empty tables give empty results; extra columns
are carried through `cleaned` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import SPACE_CHARS, stored, text_of, unused

#: Least number of sites, sketch precision (2**LG registers), and the estimates around the threshold that are counted exactly.
SITES, LG, LOW, HIGH = 5, 12, 0.8, 1.25


def line_hash(line: Column) -> Column:
    """128 bits of a line; null for a blank one."""
    bare = F.btrim(line, F.lit(SPACE_CHARS))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def _lines(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0")).alias("site"), F.explode(F.split(text_of(text_col), "\n")).alias("line"))
    return rows.select("site", line_hash(F.col("line")).alias("hash")).filter("hash is not null")


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """hash, spread (distinct sites: exact near the threshold, else estimated) of the lines on at least `sites` sites."""
    lines = _lines(docs, text_col, site_col)
    spread = lines.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG))).alias("estimate")).filter(F.col("estimate") >= sites * LOW)
    spread = stored(spread, "spread")
    near = spread.filter(F.col("estimate") <= sites * HIGH).select(F.col("hash").alias("n_hash"))
    exact = lines.join(near, F.col("hash") == F.col("n_hash"), "left_semi").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("spread"))
    return spread.filter(F.col("estimate") > sites * HIGH).select("hash", F.col("estimate").alias("spread")).unionByName(exact.filter(F.col("spread") >= sites))


def added(docs: DataFrame) -> list[str]:
    """Names of what `cleaned` adds: __clean, __lines and __removed, with more underscores where docs has such columns."""
    return unused(docs, "__clean", "__lines", "__removed")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """docs with the columns of `added`: the text without its boilerplate lines, and the numbers of lines and of those removed."""
    bad = stored(boilerplate(docs, text_col, site_col, sites), "boilerplate")
    key = F.md5(F.concat_ws("\0", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text_of(text_col)))
    lines = docs.select(key.alias("h_key"), F.posexplode(F.split(text_of(text_col), "\n")).alias("place", "line"))
    lines = lines.select("h_key", "place", line_hash(F.col("line")).alias("hash"))
    hits = lines.join(bad.select(F.col("hash").alias("b_hash")), F.col("hash") == F.col("b_hash")).groupBy("h_key").agg(F.collect_set("place").alias("places"))
    own, h_key, places = unused(docs, "key", "h_key", "places")
    rows = docs.withColumn(own, key).join(hits.toDF(h_key, places), F.col(own) == F.col(h_key), "left")
    all_lines = F.split(text_of(text_col), "\n")
    kept = F.filter(all_lines, lambda line, i: ~F.array_contains(places, i))
    clean, n_lines, removed = added(docs)
    return rows.withColumns(
        {
            clean: F.when(F.col(places).isNull(), text_of(text_col)).otherwise(F.array_join(kept, "\n")),
            n_lines: F.size(all_lines).cast("long"),
            removed: F.coalesce(F.size(places), F.lit(0)).cast("long"),
        }
    ).drop(own, h_key, places)
