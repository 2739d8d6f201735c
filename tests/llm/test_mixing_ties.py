"""Rows of one id, or of none, can be split by the cut-off of the mix."""

import collections

import pytest

from stellwerk.llm import mixing


@pytest.mark.parametrize("same", [False, True])
def test_target_is_met_without_ids(spark, same):
    rows = [(None, "a b c d" if same else f"w{i} b c d", s) for s, n in (("s1", 100), ("s2", 170), ("s3", 210)) for i in range(n)] + [(i, f"v{i} b c", "s1") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.copies(docs).select("source", "__size", "__target", "__copies").collect()
    taken = collections.Counter()
    for r in found:
        taken[r.source] += r["__copies"] * r["__size"]
    assert len(found) == len(rows)
    for r in found:
        assert abs(taken[r.source] - r["__target"]) <= 2 + 1e-6
