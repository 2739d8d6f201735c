"""The query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellwerk.llm import quality_rules
from stellwerk.llm.common import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL = {}
