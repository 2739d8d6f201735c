"""Hard negatives against plain Python integers: packed products of any size, ties, blocks, awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellwerk.llm import hard_negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every):
    first = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, v)
        first[i] = min(first.get(i, own), own)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in first.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w, strict=False)) for b, (_, w) in whole.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if whole[b][0] == label][:5]:
            bounds = [b for b in order if whole[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(bounds[:10])]
    return sorted(out)


def found(spark, rows, every, **sizes):
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, v string")
    mined = hard_negatives.mine(hard_negatives.usable(table, F.col("label")), F.col("vec_id") % every == 0, **sizes)
    return sorted(tuple(r[c] for c in COLUMNS) for r in mined.collect())


@pytest.mark.parametrize("large", [1, 200, 10**6, 10**12])
def test_packed_products(large):
    r = random.Random(large)
    rows = np.array([[r.randint(-large, large) for _ in range(5)] for _ in range(40)], dtype=np.int64 if large < 2**31 else object)
    for anchor in ([0] * 5, [large] * 5, [-large] * 5, [r.randint(-large, large) for _ in range(5)]):
        scores = hard_negatives.Packed(rows, large).scores(anchor)
        assert [int(x) for x in scores] == [min(max(sum(a * int(b) for a, b in zip(anchor, row, strict=True)), -(2**63)), 2**63 - 1) for row in rows]


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "chunk": 3}])
def test_vectors(spark, sizes):
    """Whole numbers of a narrow range: many scores are equal."""
    r = random.Random(3)
    rows = [(k, r.choice([0, 0, 1, 2]), [r.randint(-1, 2) / 256 * r.choice([1, 8]) for _ in range(6)]) for k in range(300)]
    want = plain(rows, 10)
    assert len(want) > 500 and found(spark, rows, 10, **sizes) == want


def test_awkward_rows(spark):
    r = random.Random(4)
    rows = [(k, k % 2, [r.random() for _ in range(4)]) for k in range(40)]
    rows += [(None, 0, [1.0]), (100, None, [1.0]), (110, 0, None), (120, 0, [None, 1.0]), (130, 0, [float("nan")]), (140, 0, [float("inf"), 1.0]), (150, 1, []), (160, 1, [0.5]), (170, 0, [2.0**40, 1.0]), (0, 0, [0.1]), (0, 0, [0.1])]
    assert found(spark, rows, 10) == plain(rows, 10)
    assert found(spark, rows, 10, block=7, chunk=2) == plain(rows, 10)
    assert found(spark, [], 10) == [] and found(spark, rows[1:2], 1) == []
