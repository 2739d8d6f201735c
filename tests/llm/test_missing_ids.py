"""Rows without an id, and one id on several texts."""

from stellwerk.llm import bag_minhash

SCHEMA = "doc_id long, text string"


def near(name, change=None):
    words = [f"{name}{i}" for i in range(80)]
    if change:
        words[40] = change
    return " ".join(words)


def kept(rows):
    return sorted((r.doc_id or 0, r.text) for r in bag_minhash.deduplicate(rows).collect())


def test_near_copies_without_ids(spark):
    rows = spark.createDataFrame([(None, near("a")), (None, near("a", "x")), (5, near("b")), (None, near("b", "x")), (None, near("c"))], SCHEMA)
    found = {r.hash.hex(): (r.cluster_id, r.kept) for r in bag_minhash.near_duplicates(rows).collect()}
    assert len(found) == 5 and sorted((c or 0, k) for c, k in found.values()) == [(0, False), (0, True), (0, True), (5, False), (5, True)]
    left = kept(rows)
    assert [t for i, t in left if i] == [near("b")] and len(left) == 3 and near("c") in [t for _, t in left]


def test_one_id_on_different_texts(spark):
    """The links of both texts count, and a clean text does not go with its namesake."""
    rows = spark.createDataFrame([(1, near("a", "x")), (2, near("a")), (2, near("b")), (3, near("b", "x")), (4, near("c"))], SCHEMA)
    assert kept(rows) == [(1, near("a", "x")), (2, near("b")), (4, near("c"))]
    rows = spark.createDataFrame([(1, near("a", "x")), (2, near("a")), (2, near("c"))], SCHEMA)
    assert kept(rows) == [(1, near("a", "x")), (2, near("c"))]


def test_one_id_on_near_texts(spark):
    rows = spark.createDataFrame([(2, near("a")), (2, near("a", "x"))], SCHEMA)
    assert len(kept(rows)) == 1
