"""Every operator and pipeline stage on one awkward table: nulls, ties, repeats, long texts, and columns named like the helpers."""

import pytest

import corpus_pipeline
from stellwerk.llm import bag_minhash, chat_format, exact_dedup, language_id, line_dedup, mixing, packing, quality_gam, quality_rules, toxicity
from stellwerk.llm.common import unused

#: Names that the operators use for columns of their own.
NAMES = (
    "hash h nth k_id k_hash sha k_sha key h_key places place line __clean __lines __removed __size __source_size __target __copies __own __end __chosen "
    "__lang_pred __score __rejected component bucket id n size rank norm words epochs cut part row length piece score label"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
BASE = [f"word{i}" for i in range(60)]
ROWS = [
    (1, "a  b\tc", "en", "s1"), (2, "a b c", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, LONG, "en", "s1"), (6, " ".join(BASE), "en", "s1"),
    (7, " ".join([*BASE[:30], "changed", *BASE[31:]]), "de", "s2"), (7, " ".join([*BASE[:30], "changed", *BASE[31:]]), "de", "s2"), (None, "no id at all here", "en", None),
    (None, "no id at all here", "en", None), (8, "one", "en", "s3"), (9, "\n\n", "en", "s3"), (10, " ".join(BASE), None, "s3"),
]


def odd(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *[f"{c}{k}" for c in NAMES]) for k, r in enumerate(rows)], SCHEMA)


def plain(rows):
    return sorted(rows, key=str)


def test_unused_names(spark):
    assert unused(spark.range(0).toDF("A"), "a", "b") == ["_a", "b"]


def test_rows_are_carried_whole(spark):
    """What the deduplications, the mix, language ID and line dedup return are rows of the table, as they were."""
    docs = odd(spark)
    own = {tuple(r) for r in docs.collect()}
    n = len(docs.columns)
    exact = exact_dedup.deduplicate(docs).collect()
    assert {tuple(r) for r in exact} <= own and sorted(str(r.doc_id) for r in exact) == ["1", "10", "3", "5", "6", "7", "8", "9", "None"][:1] + ["3", "5", "6", "7", "8", "9", "None"]
    assert [r.nth for r in exact if r.doc_id == 7] == ["nth6"], "of rows that repeat id and text, the first by all columns"
    near = bag_minhash.deduplicate(docs).collect()
    assert {tuple(r) for r in near} <= own and sorted(str(r.doc_id) for r in near) == ["1", "3", "5", "6", "8", "None"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= own
    told = language_id.identified(docs, None)
    assert told.columns == [*docs.columns, *language_id.added(docs)] and {tuple(r)[:n] for r in told.collect()} == own
    clean = line_dedup.cleaned(docs)
    assert clean.columns == [*docs.columns, *line_dedup.added(docs)] and plain(tuple(r)[:n] for r in clean.collect()) == plain(tuple(r) for r in docs.collect())
    copies = mixing.copies(docs)
    assert copies.columns == [*docs.columns, *mixing.added(docs)] and copies.count() == len(ROWS)


def test_operators_without_extra_columns_in_results(spark):
    docs, labels = odd(spark), spark.createDataFrame([(6, 1, 0), (5, 0, 1), (7, 1, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for table, rows in ((docs, len(ROWS)), (odd(spark, []), 0)):
        assert exact_dedup.classes(table).count() == rows == bag_minhash.near_duplicates(table).count() == quality_rules.rules(table).count()
        assert packing.pack(table).filter("piece = 0").count() == rows
        features = quality_gam.measured(table)
        assert quality_gam.scored(features, quality_gam.train(features, labels)).filter("score between 0 and 1").count() == rows
        assert toxicity.scored(*toxicity.train(table, labels)).filter("score between 0 and 1").count() == rows
        assert line_dedup.cleaned(table).count() == rows == mixing.copies(table).count()


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "a", "yes"), (2, 1, "a", "yes"), (3, 1, "a", None), (3, None, None, None), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "conv_id long, turn int, role string, text string, place string, a string, again string, prefix string")
    found = {r.conv_id: (r.n_turns, r.kept) for r in chat_format.collapsed(turns).collect()}
    assert found == {1: (1, False), 2: (2, True), 3: (2, True)}
    assert chat_format.formatted(turns.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [ROWS, ROWS[:0], ROWS[2:3]])
def test_pipeline_stages(spark, rows):
    docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).filter("piece = 0").count() == len(rows)
