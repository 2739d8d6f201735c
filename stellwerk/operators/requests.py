"""The events that a request's routes depend on, with what was seen of their runs at its departure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.risk import seen_case, train_group
from stellwerk.functions.times import minutes_between, plus_minutes
from stellwerk.operators.sampling import busy_stations
from stellwerk.operators.visibility import run_logs, seen_delay
from stellwerk.schema import BUSY_STATIONS, FIRST_HOUR, LAST_HOUR, REQUESTS_PER_DAY


def draw(key: Column, of: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the key and a name."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{of}"))), 1, 13), 16, 10).cast("double") / 2.0**52


def drawn_requests(stops: DataFrame, per_day: int = REQUESTS_PER_DAY, stations: int = BUSY_STATIONS, seed: int = 0) -> DataFrame:
    """request_id, day, src, dst, depart: so many requests for each run day.

    Both ends are drawn by their departures from the busiest stations, the end never being the start; the hours take
    turns. Draws are hashes of day, number and seed. The weights of the stations, few by parameter, travel as one row.
    """
    busy = busy_stations(stops, stations)
    below = F.coalesce(F.sum("departures").over(Window.orderBy(F.desc("departures"), "station").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = busy.withColumn("below", below).agg(F.sort_array(F.collect_list(F.struct("below", "departures", "station"))).alias("ends"), F.sum("departures").alias("total"))
    days = stops.select(F.col("run_day").alias("day")).distinct()
    asked = days.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1)))).withColumn("request_id", F.concat_ws("-", F.date_format("day", "yyyy-MM-dd"), F.col("nth").cast("string")))
    key = F.concat_ws(":", "request_id", F.lit(str(seed)))
    at = lambda t: F.element_at(F.filter("ends", lambda e: e["below"] <= t), -1)
    asked = asked.crossJoin(F.broadcast(ends)).withColumn("s", at(F.floor(draw(key, "src") * F.col("total"))))
    rest = F.floor(draw(key, "dst") * (F.col("total") - F.col("s.departures")))
    asked = asked.withColumn("d", at(F.when(rest >= F.col("s.below"), rest + F.col("s.departures")).otherwise(rest)))
    minute = (FIRST_HOUR + F.col("nth") % (LAST_HOUR - FIRST_HOUR + 1)) * 60 + F.floor(draw(key, "minute") * 60)
    return asked.filter(F.col("total") > F.col("s.departures")).select("request_id", "day", F.col("s.station").alias("src"), F.col("d.station").alias("dst"), plus_minutes(F.col("day"), minute).alias("depart"))


def request_rows(stops: DataFrame, requests: DataFrame, legs: DataFrame) -> DataFrame:
    """One row per request, run, stop and model ("dep" where a leg begins, "arr" where it ends).

    Stops columns with now, minutes_ahead, delay (of the model's event), seen_delay, case, group, weight. Legs are shuffled once, by run:
    they meet one row of their run with its stops and its log, and equal rows of a request are on the same side of that shuffle.
    """
    runs = run_logs(stops, *stops.columns).select(F.col("run_id").alias("l_run"), "log", "steps", "cells").hint("merge")
    met = legs.select("request_id", "run_id", "from_stop_num", "to_stop_num").join(requests.select("request_id", F.col("depart").alias("now")), "request_id")
    met = met.join(runs, F.col("run_id") == F.col("l_run")).withColumn("seen_delay", seen_delay(F.col("now")))
    side = lambda c, model: F.transform(F.filter("cells", lambda s: s["stop_num"] == F.col(c)), lambda s: F.struct(F.lit(model).alias("model"), s.alias("s")))
    rows = met.select("request_id", "l_run", "now", "seen_delay", F.explode(F.concat(side("from_stop_num", "dep"), side("to_stop_num", "arr"))).alias("k"))
    rows = rows.select("request_id", F.col("l_run").alias("run_id"), "k.model", "now", "seen_delay", *[F.col(f"k.s.{c}").alias(c) for c in stops.columns if c != "run_id"]).distinct()
    departs = F.col("model") == "dep"
    rows = rows.withColumns(
        {
            "minutes_ahead": minutes_between(F.when(departs, F.col("planned_dep")).otherwise(F.col("planned_arr")), F.col("now")),
            "delay": F.when(departs, F.col("dep_delay")).otherwise(F.col("arr_delay")),
            "weight": F.lit(1.0),
            "group": train_group(F.col("train_type")),
        }
    )
    return rows.withColumn("case", seen_case(F.col("seen_delay"), F.col("minutes_ahead")))


def leg_sides(stops: DataFrame, requests: DataFrame, legs: DataFrame) -> DataFrame:
    """legs with seen_delay of their run at the request's departure, and the stops rows where they begin and end as structs `on` and `off` (null if there is none)."""
    runs = run_logs(stops, *[c for c in stops.columns if c != "run_id"]).select(F.col("run_id").alias("l_run"), "log", "steps", "cells").hint("merge")
    met = legs.join(requests.select("request_id", F.col("depart").alias("now")), "request_id", "left").join(runs, F.col("run_id") == F.col("l_run"), "left")
    at = lambda c: F.get(F.filter("cells", lambda s: s["stop_num"] == F.col(c)), F.lit(0))
    return met.select(*[F.col(c) for c in legs.columns], seen_delay(F.col("now")).alias("seen_delay"), at("from_stop_num").alias("on"), at("to_stop_num").alias("off"))


def subset(rows: DataFrame, first: int | None = None, day: str | None = None, train_type: str | None = None, models: tuple[str, ...] | None = None) -> DataFrame:
    """The request rows asked for: of the first requests by id, of a day of now, of a train type, of some models."""
    if models is not None:
        rows = rows.filter(F.col("model").isin(*models))
    if day is not None:
        rows = rows.filter(F.to_date("now") == F.lit(day).cast("date"))
    if train_type is not None:
        rows = rows.filter(F.col("train_type") == train_type)
    if first is not None:
        rows = rows.join(rows.select("request_id").distinct().orderBy("request_id").limit(first), "request_id", "left_semi")
    return rows
