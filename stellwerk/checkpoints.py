"""Relations that are read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or, on a local master only, one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="spark-")
        found = _own["dir"]
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: lineage and plan end there, and later reads prune its columns.

    Lost executors lose nothing of it. `clear` deletes the tables once nothing reads them any more.
    """
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to all shuffle partitions, however few bytes it has: for small sides of joins that make many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def clear(spark: SparkSession) -> None:
    """Deletes every table that `kept` wrote in this session; results that still read them are lost."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    while _written:
        path = hadoop(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
