"""The registered corpus queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from stellwerk.llm import queries
from stellwerk.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    a = sorted(str([r[c] for c in columns]) for r in found.collect())
    assert a == sorted(str([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs = out
        counts.append(out.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == counts[-1]
