"""The query of language ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import language_id
from stellwerk.llm.common import table


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, language_id.learned())
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", (~language_id.learned()).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected")
    )


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL = {}
