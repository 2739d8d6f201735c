"""Resumable results: finished keys are skipped, and a write that broke off or is repeated leaves each key once.

A write makes a batch, a folder of its own, and lists it in a manifest as its last step. Readers take listed batches only,
so what a killed write left behind is not seen, and `sweep` deletes it. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of path, and its class of paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    fs, make = _files(spark, path)
    found = fs.listStatus(make(path)) if fs.exists(make(path)) else []
    return sorted(n.removeprefix(prefix) for n in (f.getPath().getName() for f in found) if n.startswith(prefix) and not n.startswith("."))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The batches that the manifest lists."""
    return _names(spark, f"{path}/_manifest")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The results of all listed batches; None before the first write."""
    batches = listed(spark, path)
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f"{path}/batch={b}" for b in batches]).drop("batch") if batches else None


def finished(spark: SparkSession, path: str, *keys: str) -> DataFrame | None:
    """The keys that the results at path hold; None before the first write."""
    done = read(spark, path)
    return None if done is None else done.select(*keys).distinct()


def pending(work: DataFrame, path: str, *keys: str) -> DataFrame:
    """The rows of work whose keys have no results yet."""
    done = finished(work.sparkSession, path, *keys)
    return work if done is None else work.join(done, list(keys), "left_anti").select(work.columns)


def add(results: DataFrame, path: str, *keys: str, partition_by: tuple[str, ...] = ()) -> str:
    """Adds the results whose keys are not there yet, as one batch, and returns its name; keys: request_id by default.

    partition_by: columns, such as method or split, that become folders and that readers prune by.
    """
    spark, batch = results.sparkSession, uuid.uuid4().hex
    pending(results, path, *(keys or ("request_id",))).write.partitionBy(*partition_by).parquet(f"{path}/batch={batch}")
    fs, make = _files(spark, path)
    fs.mkdirs(make(f"{path}/_manifest"))
    fs.create(make(f"{path}/_manifest/{batch}"), False).close()
    return batch


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Deletes the batches that no manifest lists, and names them; not while a write is under way."""
    left = sorted(set(_names(spark, path, "batch=")) - set(listed(spark, path)))
    fs, make = _files(spark, path)
    for batch in left:
        fs.delete(make(f"{path}/batch={batch}"), True)
    return left


def all_methods(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The results of several methods, each with a path of its own, as one relation with a method column."""
    frames = [spark.read.parquet(path).withColumn("method", F.lit(name)) for name, path in paths.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def with_results(rows: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Every row with its stored results, null where there are none; results hold at most one row for equal keys."""
    news = [c for c in results.columns if c not in rows.columns]
    return rows.join(results.select(*keys, *news), list(keys), "left")
