"""The query of spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellwerk.llm import spelling
from stellwerk.llm.common import table


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE_SQL = {}
