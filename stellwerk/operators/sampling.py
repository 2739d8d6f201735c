"""Samples that do not depend on partitions: rows are ranked by a hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.risk import train_group
from stellwerk.operators.visibility import at_cutoff
from stellwerk.functions.times import last_event_time, plus_minutes
from stellwerk.schema import HISTORY_DAYS, ROWS_PER_TYPE, RUNS_PER_GROUP


def hash_order(seed: int, *keys: str) -> Column:
    """An order that any engine can repeat."""
    return F.md5(F.concat_ws(":", *keys, F.lit(str(seed))))


def hash_number(seed: int, *keys: str) -> Column:
    """64 bits, for what is counted or cut by ranges of the hash."""
    return F.xxhash64(*keys, F.lit(seed))


def week_runs(stops: DataFrame) -> DataFrame:
    """One row per run: day, type, group, number of rows."""
    runs = stops.groupBy("run_id").agg(F.min("run_day").alias("run_day"), F.min("train_type").alias("train_type"), F.count(F.lit(1)).alias("n_rows"))
    return runs.withColumn("group", train_group(F.col("train_type")))


def stratified_runs(runs: DataFrame, most: int = RUNS_PER_GROUP, seed: int = 0) -> DataFrame:
    """At most so many runs of each group, by the hash of their id."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy(hash_order(seed, "run_id"), "run_id"))
    return runs.withColumn("nth", rank).filter(F.col("nth") <= most).drop("nth")


def group_weights(runs: DataFrame, drawn: DataFrame) -> DataFrame:
    """For each group its share of all rows by the number of its rows that were drawn."""
    all_rows = runs.groupBy("group").agg(F.sum("n_rows").alias("n_all"))
    taken = drawn.groupBy("group").agg(F.sum("n_rows").alias("n_drawn"))
    share = F.col("n_all") / F.sum("n_all").over(Window.partitionBy())
    return all_rows.withColumn("share", share).join(taken, "group").withColumn("weight", F.col("share") / F.col("n_drawn"))


def busy_stations(stops: DataFrame, n: int, split: str | None = "context") -> DataFrame:
    """The n stations with most departures; equal ones by name.

    Of the context split, so that requests drawn by them use nothing of the tested days; with None, of all days.
    """
    rows = stops.filter("planned_dep is not null") if split is None else stops.filter((F.col("split") == split) & F.col("planned_dep").isNotNull())
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("departures")).orderBy(F.desc("departures"), "station").limit(n)


def capped(rows: DataFrame, keys: list[str], cap: int, order: Column, *ties: str) -> DataFrame:
    """At most cap rows alike in keys: those with the least order (a 64-bit hash), then by ties.

    Rows are counted by the hash's upper 12 bits; whole ranges are taken or left, and only the range in which the cap lies is sorted.
    Rows meet one row for each of the keys (days and types, few), with that range. It is hinted: rows that were dealt to days look
    smaller than they are, and the driver must not get them as the side to broadcast. A missing key is one like others.
    """
    marked = rows.withColumns({"order_": order, "range_": F.shiftright(order, 52)})
    counts = marked.groupBy(*keys, "range_").agg(F.count(F.lit(1)).alias("n_"))
    counts = counts.withColumn("upto_", F.sum("n_").over(Window.partitionBy(*keys).orderBy("range_")))
    over = F.min(F.when(F.col("upto_") > cap, F.struct("range_", (F.col("upto_") - F.col("n_")).alias("below"))))
    cuts = counts.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(over.alias("cut_"))
    marked = marked.join(F.broadcast(cuts), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("order_", *ties))
    last = marked.filter(F.col("range_") == F.col("cut_.range_")).withColumn("nth_", nth).filter(F.col("nth_") <= cap - F.col("cut_.below")).drop("nth_")
    return marked.filter(F.col("cut_").isNull() | (F.col("range_") < F.col("cut_.range_"))).unionByName(last).select(*rows.columns)


def _with_cutoff(rows: DataFrame, stops: DataFrame, model: str, horizon: int, seed: int, keys: tuple[str, ...]) -> DataFrame:
    ahead = F.pmod(hash_number(seed + 1, *keys), F.lit(horizon))
    return at_cutoff(rows, stops, plus_minutes(F.col(f"planned_{model}"), -ahead), model)


def capped_training_rows(stops: DataFrame, model: str, cap: int = ROWS_PER_TYPE, horizon: int = 360, seed: int = 0) -> DataFrame:
    """Usable rows, at most cap of each train type, with a cutoff up to horizon minutes ahead and what was known then."""
    usable = stops.filter(F.col(f"{model}_delay").isNotNull() & ~F.col(f"{model}_canceled"))
    rows = capped(usable, ["train_type"], cap, hash_number(seed, "run_id", "stop_num"), "run_id", "stop_num")
    return _with_cutoff(rows, stops, model, horizon, seed, ("run_id", "stop_num"))


def _learnable(stops: DataFrame, model: str, history_days: int) -> DataFrame:
    """Usable rows with the first and the last day (first_, last_) that may learn from them: after the run's day and the row's last event, at most history_days after the run's day."""
    usable = stops.filter(F.col(f"{model}_delay").isNotNull() & ~F.col(f"{model}_canceled"))
    first = F.greatest(F.date_add("run_day", 1), F.date_add(F.to_date(last_event_time()), 1))
    return usable.withColumns({"first_": first, "last_": F.date_add("run_day", history_days)}).filter("first_ <= last_")


def _on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """rows once for each of days (day) from first_ to last_."""
    dealt = rows.withColumn("day", F.explode(F.sequence("first_", "last_"))).withColumn("day", F.col("day").cast("timestamp_ntz"))
    return dealt.drop("first_", "last_").join(F.broadcast(days.select("day").distinct()), "day", "left_semi")


def training_rows(stops: DataFrame, days: DataFrame, model: str, cap: int = ROWS_PER_TYPE, horizon: int = 360, seed: int = 0, history_days: int = HISTORY_DAYS) -> DataFrame:
    """For each of days (day), the usable rows of the days before it whose last event lies before it, capped and cut off as above.

    Nothing of the day itself, or that ended on it, is learned from.
    """
    dealt = _on_days(_learnable(stops, model, history_days), days)
    rows = capped(dealt, ["day", "train_type"], cap, hash_number(seed, "run_id", "stop_num"), "run_id", "stop_num")
    return _with_cutoff(rows, stops, model, horizon, seed, ("day", "run_id", "stop_num"))


def training_history(stops: DataFrame, days: DataFrame, model: str, history_days: int = HISTORY_DAYS) -> DataFrame:
    """day, train_type, n_rows, runs, delays: for each of days (day) and each type, all rows that training_rows draws from, their runs and the sum of their delays.

    Nothing is capped. Rows and runs are counted by the first and last day that may learn from them, and only these counts are dealt
    to days; a run, which has one day, is there from the first day of any of its rows. A missing type is a group of its own.
    """
    rows = _learnable(stops, model, history_days)
    none, cell = F.lit(0).cast("long"), ("train_type", "first_", "last_")
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_rows"), none.alias("runs"), F.sum(F.col(f"{model}_delay").cast("long")).alias("delays"))
    runs = rows.groupBy("run_id", "train_type", "last_").agg(F.min("first_").alias("first_"))
    runs = runs.groupBy(*cell).agg(none.alias("n_rows"), F.count("run_id").alias("runs"), none.alias("delays"))
    return _on_days(counts.unionByName(runs), days).groupBy("day", "train_type").agg(*[F.sum(c).alias(c) for c in ("n_rows", "runs", "delays")])
