"""What the corpus operators share: reading tables, words, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, and a word, in Java's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The six white space characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="spark-")
        found = _own["dir"]
    return found.rstrip("/")


#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1000


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to be a column of df (names are alike in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While it lasts, Arrow batches sent to Python hold at most so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, and lost executors lose nothing.

    batch_rows: the most rows of an Arrow batch, for stages that send whole texts to Python.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _batches_of(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_of(rows: DataFrame, keys: list[str], columns: list[str], nth: str) -> DataFrame:
    """Of the rows alike in keys, the first by all columns that can be ordered; nth is a free name for its rank."""
    kinds = dict(rows.dtypes)
    order = [F.col(f"`{c}`") for c in columns if "map<" not in kinds[c] and kinds[c] != "variant"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(nth, rank).filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in columns])


def text_of(column: str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def one_space(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, SPACE, " ")


def hash_128(text: Column) -> Column:
    """128 bits of a text that is not null; never null itself, so that joins need not compute it twice to know."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows, for a broadcast; it stops counting there."""
    return df.limit(most + 1).count() <= most


def small_or_shuffled(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint behind a check of the size; beyond it, the join shuffles."""
    return F.broadcast(df) if few(df, most) else df
