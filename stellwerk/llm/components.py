"""Connected components of a graph given as edges: first within partitions, then in rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import stored

#: Graphs of at most so many edges (a few megabytes) are finished in one task; larger ones are shuffled in rounds.
SMALL = 1 << 17
#: A partition's edges are contracted in portions of about so many.
PORTION = 1 << 20


def hung(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, each with the least node of its component."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    top = np.arange(len(nodes))
    while len(a):
        np.minimum.at(top, np.maximum(top[a], top[b]), np.minimum(top[a], top[b]))
        while not np.array_equal(top, up := top[top]):
            top = up
        open_ = top[a] != top[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[top]


def _contracted(batches: Iterator[pa.RecordBatch], roots: bool) -> Iterator[pa.RecordBatch]:
    """Of each portion of a partition's edges (u, v): its nodes under the least ones of their components; the least ones too if roots."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        u, v = hung(*(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1)))
        keep = slice(None) if roots else u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PORTION:
            held, n = [out()], 0
            if not roots:
                yield held.pop()
    if held:
        yield out()


def _pair(*sides) -> Column:
    """Column that explodes to one (u, v) for each of the sides."""
    return F.explode(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in sides])).alias("e")


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (u > v): every neighbour is hung under the least one."""
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    both = edges.select(_pair((u, v), (v, u))).select("e.u", "e.v")
    least = both.groupBy(u.alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    large = both.filter("v > u").join(least, u == F.col("k")).select(v.alias("u"), m.alias("v")).filter("u != v").distinct()
    down = large.groupBy(u.alias("k")).agg(F.min("v").alias("m"))
    hung_ = large.join(down, u == F.col("k"))
    return hung_.select(_pair((F.greatest("v", "m"), F.least("v", "m")), (F.col("k"), m))).select("e.u", "e.v").filter("u != v").distinct()


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, component (least node of it) for the nodes of edges (a, b); nodes without an edge are not in it.

    Every partition contracts its own edges to a forest. What is left is finished in one task if it is small;
    else each round is written to the shared folder, and the rounds end when the edges no longer change,
    which they do after a number of rounds in the order of the logarithm of the nodes.
    """
    own = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(own.mapInArrow(lambda it: _contracted(it, False), "u long, v long"), "edges")
    if now.count() <= small:
        return stored(now.coalesce(1).mapInArrow(lambda it: _contracted(it, True), "u long, v long"), "components").toDF("node", "component")
    now, before = stored(now.distinct(), "edges"), None
    while before != (state := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()):
        before = state
        now = stored(_star(now), "edges")
    return now.select(_pair((F.col("u"), F.col("v")), (F.col("v"), F.col("v")))).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct()
