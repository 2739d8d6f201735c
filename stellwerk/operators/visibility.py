"""What was known at a moment: event-time visibility, connections and last known delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.checkpoints import dealt
from stellwerk.functions.times import actual_time, day_of, minutes_between, plus_minutes


def known_at(stops: DataFrame, now: Column) -> DataFrame:
    """Rows of runs that began before now, with only the delays of events that happened before now; at least one of them."""
    out = stops.filter(F.col("run_day") < now)
    seen = {f"{e}_delay": F.when(actual_time(e) < now, F.col(f"{e}_delay")) for e in ("arr", "dep")}
    return out.withColumns(seen).filter(F.col("arr_delay").isNotNull() | F.col("dep_delay").isNotNull())


def since(now: Column, days: int) -> Column:
    """Runs from midnight of now's day less so many days."""
    return F.col("run_day") >= plus_minutes(day_of(now), F.lit(-1440 * days))


def connections(stops: DataFrame, *by: str) -> DataFrame:
    """Hops between consecutive stops of a run that do not arrive before they depart; `by`: columns whose values are kept apart, and carried."""
    run = Window.partitionBy(*by, "run_id").orderBy("stop_num")
    ahead = {f"next_{c}": F.lead(c).over(run) for c in ("station", "stop_num", "planned_arr", "arr_delay", "arr_canceled")}
    hops = stops.withColumns(ahead).filter("planned_dep is not null and next_planned_arr is not null and next_planned_arr >= planned_dep")
    return hops.select(
        *by, "run_id", "run_day", "train_key", "line_number", "station", "stop_num", "next_station", "next_stop_num", F.col("planned_dep").alias("dep"),
        actual_time("dep").alias("dep_actual"), "dep_canceled", F.col("next_planned_arr").alias("arr"),
        plus_minutes(F.col("next_planned_arr"), F.col("next_arr_delay")).alias("arr_actual"), F.col("next_arr_canceled").alias("arr_canceled"),
    )


def timetable(stops: DataFrame, day: str) -> DataFrame:
    """The connections of a day: runs of the day and its neighbours, planned from noon before to noon after next."""
    start = F.lit(day).cast("timestamp_ntz")
    planned = F.coalesce("planned_dep", "planned_arr")
    near = stops.filter(F.col("run_day").between(plus_minutes(start, F.lit(-1440)), plus_minutes(start, F.lit(1440))))
    near = near.filter(planned.between(plus_minutes(start, F.lit(-720)), plus_minutes(start, F.lit(2160))))
    return connections(near).filter(F.col("dep") >= start)


def timetables(stops: DataFrame, days: DataFrame) -> DataFrame:
    """The timetable of each of days (day), with the day: every stop is dealt to its run's day and the two next to it."""
    around = F.explode(F.array(*[plus_minutes(F.col("run_day"), F.lit(1440 * k)) for k in (-1, 0, 1)]))
    near = stops.withColumn("day", around).join(days.select("day").distinct(), "day", "left_semi")
    planned = F.coalesce("planned_dep", "planned_arr")
    near = near.filter(planned.between(plus_minutes(F.col("day"), F.lit(-720)), plus_minutes(F.col("day"), F.lit(2160))))
    return connections(near, "day").filter(F.col("dep") >= F.col("day"))


def train_history(stops: DataFrame, days_back: int, most: int) -> DataFrame:
    """day, train_key, nth, run_id, stop_num: for each day on which a train runs, its rows of the days before with a known event, latest day first.

    A row meets, at its train, the days on which that runs, and is dealt to days only after that shuffle: no task sorts or
    sends a row for each of the days before it.
    """
    from_day = F.date_add(F.to_date(F.least(actual_time("arr"), actual_time("dep"))), 1)
    rows = stops.select("train_key", "run_day", "run_id", "stop_num", F.greatest(F.date_add("run_day", 1), from_day).alias("first"), F.date_add("run_day", days_back).alias("last"), from_day.alias("known"))
    rows = dealt(rows.filter("known is not null and first <= last").drop("known"), "train_key")
    days = stops.groupBy(F.col("train_key").alias("d_key")).agg(F.collect_set(F.to_date("run_day")).alias("days")).hint("merge")
    past = rows.join(days, F.col("train_key") == F.col("d_key")).withColumn("day", F.explode(F.filter("days", lambda d: d.between(F.col("first"), F.col("last")))))
    order = Window.partitionBy("train_key", "day").orderBy(F.desc("run_day"), "run_id", "stop_num")
    past = past.select("train_key", "day", "run_day", "run_id", "stop_num").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    return past.select(F.col("day").cast("timestamp_ntz").alias("day"), "train_key", "nth", "run_id", "stop_num")


def stop_index(stops: DataFrame) -> DataFrame:
    """run_id, stop_num, stop_index: stops numbered by planned time within the run; null without a time."""
    time = F.coalesce("planned_arr", "planned_dep")
    order = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("t"), "stop_num")
    return stops.withColumn("t", time).withColumn("stop_index", F.when(F.col("t").isNotNull(), F.row_number().over(order)))


def cutoff(model: str, now: Column, replay: bool) -> Column:
    """now; for a replay the earliest of now, the same clock time on the event's day, and the event itself."""
    if not replay:
        return now
    clock = minutes_between(now, day_of(now))
    return F.least(now, plus_minutes(day_of(F.col(f"planned_{model}")), clock), actual_time(model))


def run_logs(stops: DataFrame, *cells: str) -> DataFrame:
    """One row per run: nums, its stop numbers by stop index (from 1), and log, its events by time and place, as arrays; steps for searches.

    An event's place is twice its stop index, and one more for a departure. in_order: whether places rise with time, as
    they do unless a later stop was left before an earlier one. Joins with logs are hinted not to broadcast them: Spark takes
    their size from that of the files that stops were read from, and arrays are far larger. cells: columns of the run's stops to keep with it.
    """
    sides = F.array(
        *[
            F.struct(actual_time(e).alias("time"), (2 * F.col("stop_index") + int(e == "dep")).alias("place"), F.col(f"planned_{e}").alias("planned"), F.col(f"{e}_delay").alias("delay"))
            for e in ("arr", "dep")
        ]
    )
    own = [F.struct(*cells).alias("cell")] if cells else []
    rows = stop_index(stops).select("run_id", "stop_num", "stop_index", sides.alias("sides"), *own)
    runs = rows.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("stop_index", "stop_num"))).alias("nums"), F.sort_array(F.filter(F.flatten(F.collect_list("sides")), lambda e: e["time"].isNotNull())).alias("log"),
        *[F.collect_list("cell").alias("cells")] * len(own),
    )
    nums = F.filter("nums", lambda x: x["stop_index"].isNotNull())["stop_num"]
    runs = runs.select("run_id", nums.alias("nums"), "log", F.col("log.place").alias("places"), *["cells"] * len(own))
    steps = F.filter(F.array(*[F.lit(2**k) for k in range(24, -1, -1)]), lambda step: step <= F.size("log"))
    return runs.withColumns({"in_order": F.col("places") == F.array_sort("places"), "steps": steps}).drop("places")


def _below(values: Column, limit: Column) -> Column:
    """How many of the log's values, in ascending order, lie below the limit: binary search, by the powers of two up to its size."""
    return F.aggregate("steps", F.lit(0), lambda at, step: F.when(F.coalesce(F.get(values, at + step - 1) < limit, F.lit(False)), at + step).otherwise(at))


def at_cutoff(rows: DataFrame, stops: DataFrame, cut: Column, model: str) -> DataFrame:
    """rows with last_known_delay, minutes_since_known, stops_since_known.

    The last event of the same run before the row's cutoff, at an earlier stop or, for a departure, the arrival at the
    same stop. Equal times: the later stop, then the departure. Rows meet one row of their run, whose log they search: in
    a log in order, the last event is where the earlier of two bounds lies, by time and by place; other logs are filtered.
    """
    targets = rows.withColumn("cutoff", cut).join(run_logs(stops).withColumnRenamed("run_id", "l_run").hint("merge"), F.col("run_id") == F.col("l_run"), "left")
    index = F.nullif(F.array_position("nums", F.col("stop_num")), F.lit(0)).cast("int")
    targets = targets.withColumn("stop_index", index).withColumn("limit", 2 * F.col("stop_index") + int(model == "dep"))
    ordered = F.get("log", F.least(_below(F.col("log.time"), F.col("cutoff")), _below(F.col("log.place"), F.col("limit"))) - 1)
    searched = F.try_element_at(F.filter("log", lambda e: (e["time"] < F.col("cutoff")) & (e["place"] < F.col("limit"))), F.lit(-1))
    targets = targets.withColumn("e", F.when(F.col("in_order"), ordered).otherwise(searched))
    return targets.withColumns(
        {
            "last_known_delay": F.col("e.delay"),
            "minutes_since_known": minutes_between(F.col(f"planned_{model}"), F.col("e.planned")),
            "stops_since_known": F.col("stop_index") - F.floor(F.col("e.place") / 2).cast("int"),
        }
    ).drop("l_run", "nums", "log", "in_order", "steps", "limit", "e", "stop_index", "cutoff")


def with_last_known(rows: DataFrame, stops: DataFrame, now: Column, model: str, replay: bool) -> DataFrame:
    return at_cutoff(rows, stops, cutoff(model, now, replay), model)


def seen_delay(now: Column) -> Column:
    """For rows that have met their run's log: the delay of its last event before now, at whatever stop."""
    return F.get("log", _below(F.col("log.time"), now) - 1)["delay"]


def last_seen(stops: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (request_id, run_id, now) with seen_delay: the run's last event before now, at whatever stop."""
    logs = run_logs(stops).select(F.col("run_id").alias("l_run"), "log", "steps").hint("merge")
    seen = asked.join(logs, F.col("run_id") == F.col("l_run"), "left")
    return seen.withColumn("seen_delay", seen_delay(F.col("now"))).drop("l_run", "log", "steps")
