"""What a model reads of a stop: usable rows, feature columns and shared codes of the categorical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The features of every model, and those of one event.
CATEGORICAL = ("train_type", "station", "train_key", "line_number")
NUMERIC = ("weekday", "run_planned_min", "stop_num", "n_stops", "stop_frac")
EVENT_NUMERIC = {"arr": ("arr_hour", "arr_minute"), "dep": ("dep_hour", "dep_minute", "dwell_planned_min")}


def feature_columns(model: str, *extra: str) -> list[str]:
    return [*CATEGORICAL, *NUMERIC, *EVENT_NUMERIC[model], *extra]


def with_days_ago(rows: DataFrame, day: Column) -> DataFrame:
    """Days from the row's run day to the request's day; 0 for runs of that day."""
    return rows.withColumn("days_ago", F.datediff(day, "run_day"))


def usable_rows(rows: DataFrame, model: str) -> DataFrame:
    """Rows that can be learned from: the model's event is known and not canceled."""
    return rows.filter(F.col(f"{model}_delay").isNotNull() & ~F.col(f"{model}_canceled"))


def of_event(rows: DataFrame, event: str) -> DataFrame:
    """rows with the columns of one event only, named without its prefix."""
    other = {"arr": "dep_", "dep": "arr_"}[event]
    kept = [c for c in rows.columns if not c.startswith(other)]
    return rows.select(*[F.col(c).alias(c.removeprefix(f"{event}_")) for c in kept])


def coded(context: DataFrame, query: DataFrame, model: str, *extra: str, by: str = "request_id") -> DataFrame:
    """Context and query rows as features: by, run_id, stop_num, asked (a query row), target, then feature_columns (stop_num once).

    A category's code is its place, from 0, among the values that a request's context and query rows hold
    together, so both read the same list; null stays null. A request's rows, bounded by the size of its context,
    are shuffled once and sorted once for each categorical column.
    """
    numeric = [c for c in feature_columns(model, *extra) if c not in (*CATEGORICAL, "stop_num")]
    own = [by, "run_id", "stop_num", F.col(f"{model}_delay").alias("target"), *CATEGORICAL, *numeric]
    rows = context.select(*own, F.lit(False).alias("asked")).unionByName(query.select(*own, F.lit(True).alias("asked")))
    place = {c: F.dense_rank().over(Window.partitionBy(by).orderBy(F.asc_nulls_last(c))) - 1 for c in CATEGORICAL}
    rows = rows.withColumns({f"{c}_code": F.when(F.col(c).isNotNull(), p) for c, p in place.items()})
    codes = [F.col(f"{c}_code").alias(c) for c in CATEGORICAL]
    return rows.select(by, "run_id", "stop_num", "asked", "target", *codes, *numeric)
