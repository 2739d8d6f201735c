"""Hard-negative mining by exact integer inner products in Kronecker-packed integers.

The components of many candidates are biased to be positive and laid side by side in one wide integer for each
dimension: field j of integer i holds component i of candidate j. An anchor multiplies each of these integers once by
its own component and adds them up; every field of the sum then holds the anchor's exact score with one candidate.
Fields are as wide as the largest sum that can occur, so they never run into each other, whatever the components are.

Rows are dealt to blocks of candidates, anchors to chunks; each pair of a block and a chunk is one group. A first pass
finds every anchor's positives, a second one the negatives between the bounds that the positives set. A group returns
at most `positives` or `positives * negatives` rows for an anchor, which windows by anchor merge.

Defined results: rows with a null id, label or vector or a component that is null or not finite take no part; of rows
alike in id only the first by label and vector does; a component beyond the end of a vector counts as 0; equal scores
go by the smaller id; an anchor without positives, or a positive without negatives in its bounds, has no rows; a score
beyond 64 bits counts as the nearest one within; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.common import stored

#: Candidates of a block and anchors of a chunk.
BLOCK, CHUNK = 8192, 1024
POSITIVES, NEGATIVES = 5, 10
#: A negative's score times 100 lies between these parts of its positive's.
LEAST, MOST = 30, 90
#: Components from here on are no longer handled as 64-bit integers.
LARGE = 2.0**31


def usable(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, v (doubles) of the rows that take part, one of each id."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).filter("vec_id is not null and label is not null and v is not null")
    own = own.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def whole_components(vectors: list, width: int) -> np.ndarray:
    """floor(256 x) of each component, one row a vector, zeros beyond its end; Python integers where they are large."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    if np.abs(out).max(initial=0.0) < LARGE / 256:
        return np.floor(out * 256.0).astype(np.int64)
    #: Times 256 only moves the exponent; beyond the largest double it is done after the whole part.
    whole = lambda x: int(x) * 256 if abs(x) > 2.0**60 else math.floor(x * 256.0)
    return np.array([[whole(x) for x in row] for row in out.tolist()], dtype=object).reshape(out.shape)


class Packed:
    """Candidates' components as one wide integer for each dimension."""

    def __init__(self, rows: np.ndarray, most: int):
        """rows: candidates by dimensions; most: the largest absolute component of any anchor."""
        self.n, dims = rows.shape
        self.bias = int(np.abs(rows).max(initial=0))
        #: |score + bias * sum of the anchor's components| is at most this.
        self.limit = 2 * self.bias * most * max(dims, 1) + 1
        bits = (2 * self.limit).bit_length()
        self.bytes = 4 if bits <= 32 else 8 if bits <= 63 else (bits + 7) // 8
        self.fields = [self._wide(rows[:, i]) for i in range(dims)]
        self.base = self.limit * self._wide_of([1] * self.n)

    def _wide(self, column: np.ndarray) -> int:
        if self.bytes <= 8 and column.dtype != object:
            return int.from_bytes((column + self.bias).astype(f"<u{self.bytes}").tobytes(), "little")
        return self._wide_of([int(c) + self.bias for c in column])

    def _wide_of(self, values: list[int]) -> int:
        return int.from_bytes(b"".join(v.to_bytes(self.bytes, "little") for v in values), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The anchor's exact scores with all candidates: one multiplication for each of its components."""
        total = self.base
        for a, wide in zip(anchor, self.fields, strict=True):
            total += a * wide
        moved = self.bias * sum(anchor) + self.limit
        raw = total.to_bytes(self.bytes * self.n, "little")
        if self.bytes <= 8:
            return np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64) - moved
        found = [int.from_bytes(raw[k : k + self.bytes], "little") - moved for k in range(0, len(raw), self.bytes)]
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in found], dtype=object)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` by score, largest first, then by id."""
    if len(scores) > 4 * most and scores.dtype != object:
        kth = np.partition(scores, len(scores) - most)[len(scores) - most]
        place = np.flatnonzero(scores >= kth)
    else:
        place = np.arange(len(scores))
    order = sorted(place.tolist(), key=lambda k: (-int(scores[k]), int(ids[k])))
    return np.array(order[:most], dtype=np.int64)


def _sides(anchors: pd.DataFrame, rows: pd.DataFrame) -> tuple[list[list[int]], np.ndarray, int]:
    """The anchors' components, the candidates', and the largest absolute component of an anchor."""
    width = max(max(map(len, anchors["v"]), default=0), max(map(len, rows["v"]), default=0))
    a = whole_components(list(anchors["v"]), width)
    return [[int(x) for x in row] for row in a], whole_components(list(rows["v"]), width), int(np.abs(a).max(initial=0))


def positives_of(anchors: pd.DataFrame, rows: pd.DataFrame, most: int = POSITIVES) -> Iterator[tuple[int, int, int]]:
    """anchor, other row of the same label, score: the best of each anchor; labels that no anchor has are not multiplied."""
    rows = rows[rows["label"].isin(set(anchors["label"]))].sort_values("label", kind="stable")
    wide, cand, large = _sides(anchors, rows)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    packed: dict[int, tuple[Packed, np.ndarray]] = {}
    for anchor, label, comps in zip(anchors["vec_id"], anchors["label"], wide, strict=True):
        if label not in packed:
            lo, hi = np.searchsorted(labels, [label, label + 1])
            packed[label] = Packed(cand[lo:hi], large), ids[lo:hi]
        block, own = packed[label]
        if block.n:
            scores, others = block.scores(comps), own != anchor
            scores, others = scores[others], own[others]
            for k in _best(scores, others, most):
                yield int(anchor), int(others[k]), int(scores[k])


def negatives_of(anchors: pd.DataFrame, rows: pd.DataFrame, most: int = NEGATIVES, least_part: int = LEAST, most_part: int = MOST) -> Iterator[tuple[int, int, int, int, int]]:
    """anchor, positive, its score, row of another label, its score: the best within the bounds of each positive (found: its id and score)."""
    wide, cand, large = _sides(anchors, rows)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    block = Packed(cand, large)
    for anchor, label, found, comps in zip(anchors["vec_id"], anchors["label"], anchors["found"], wide, strict=True):
        other = labels != label
        scores, names = block.scores(comps)[other], ids[other]
        for positive in found:
            p = int(positive["positive_score"])
            low, high = -(-least_part * p // 100), most_part * p // 100
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            for k in _best(scores[inside], names[inside], most):
                yield int(anchor), int(positive["positive_id"]), p, int(names[inside][k]), int(scores[inside][k])


def _grid(rows: DataFrame, anchors: DataFrame, block: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to blocks and repeated for each chunk of anchors, anchors dealt to chunks and repeated for each block.

    The counts are taken once and set how many blocks and chunks there are; no row is left out.
    """
    blocks = max(1, -(-rows.count() // block))
    chunks = max(1, -(-anchors.count() // chunk))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    return rows.select("*", own(blocks).alias("b")).withColumn("c", each(chunks)), anchors.select("*", own(chunks).alias("c")).withColumn("b", each(blocks))


def _first(rows: DataFrame, keys: list[str], score: str, name: str, most: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name))
    return rows.withColumn("rank", order).filter(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, v, see `usable`)."""
    rows = stored(rows, "vectors")
    #: New names of the columns, as both sides come from the same rows.
    anchors = rows.filter(is_anchor).select(*[F.col(c).alias(c) for c in rows.columns])

    def same(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = positives_of(a, r, positives) if len(a) and len(r) else ()
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score"])

    def other(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = negatives_of(a, r, negatives) if len(a) and len(r) else ()
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    r, a = _grid(rows, anchors, block, chunk)
    near = a.groupBy("b", "c").cogroup(r.groupBy("b", "c")).applyInPandas(same, "anchor_id long, positive_id long, positive_score long")
    near = _first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    lists = stored(near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found")), "positives")
    r, a = _grid(rows, anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "found"), block, chunk)
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = a.groupBy("b", "c").cogroup(r.groupBy("b", "c")).applyInPandas(other, schema)
    hard = _first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
