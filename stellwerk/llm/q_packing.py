"""The query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellwerk.llm import packing
from stellwerk.llm.common import table


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE_SQL = {}
