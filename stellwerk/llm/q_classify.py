"""The queries of the quality classifier and of toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import quality_gam, toxicity
from stellwerk.llm.common import table
from stellwerk.llm.labelled import held_out


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality_gam.measured(table(spark, sf_dir, "documents"))
    model = quality_gam.train(features, table(spark, sf_dir, "labels"))
    return quality_gam.scored(features, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(found, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier, "op10_toxicity": op10_toxicity}
ORACLE_SQL = {}
