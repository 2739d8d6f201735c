"""Delay quantiles from past days, from the finest level that has enough of them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.checkpoints import kept
from stellwerk.functions.times import last_event_time
from stellwerk.schema import HISTORY_DAYS, MIN_COUNT, QCOLS, QUANTILES

LEVELS = (("train_key", "station"), ("station", "hour"), ())


def past_delays(stops: DataFrame, model: str, history_days: int = HISTORY_DAYS) -> DataFrame:
    """train_key, station, hour, delay of each event that can be learned from, with the first and last day on which it counts as past."""
    usable = stops.filter(F.col(f"{model}_delay").isNotNull() & ~F.col(f"{model}_canceled"))
    first = F.greatest(F.date_add("run_day", 1), F.date_add(F.to_date(last_event_time()), 1))
    rows = usable.select(
        "train_key", "station", F.col(f"{model}_hour").cast("byte").alias("hour"), F.col(f"{model}_delay").cast("double").alias("delay"), first.alias("first_day"), F.date_add("run_day", history_days).alias("last_day")
    )
    return rows.filter("first_day <= last_day")


def _quantiles_by_day(past: DataFrame, needed: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """day, keys, n and the quantiles of past for each of needed (day, keys).

    The history meets the days that are asked for at its key, not each day on its own: rows are dealt to days only after
    the one shuffle by key, which the aggregate by day and key needs as well. Coarse levels are counted before it.
    """
    days = needed.groupBy(*keys).agg(F.collect_set("day").alias("days"))
    if keys == LEVELS[0]:
        counts = past.select(*keys, "first_day", "last_day", "delay", F.lit(1).alias("n"))
    else:
        counts = past.groupBy(*keys, "first_day", "last_day", "delay").agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(days.withColumnsRenamed({c: f"d_{c}" for c in keys}), reduce(and_, [F.col(c) == F.col(f"d_{c}") for c in keys])) if keys else counts.crossJoin(F.broadcast(days))
    inside = F.filter("days", lambda d: d.between(F.col("first_day"), F.col("last_day")))
    dealt = met.select(*keys, "delay", "n", F.explode(inside).alias("day"))
    return dealt.groupBy(*keys, "day").agg(F.percentile("delay", F.array(*map(F.lit, QUANTILES)), F.col("n")).alias(name), F.sum("n").alias("n"))


def level_quantiles(stops: DataFrame, query: DataFrame, model: str, levels=LEVELS, history_days: int = HISTORY_DAYS, min_count: int = MIN_COUNT) -> DataFrame:
    """query with level0, level1, ...: quantiles of the days before each row's run_day at each level.

    Null where a level has fewer than min_count rows (the level without keys takes any number), or where the event does
    not exist. Only the keys and days of the query's rows are looked at.
    """
    out = query.withColumns({"b_day": F.to_date("run_day"), "hour": F.col(f"{model}_hour").cast("byte")})
    past = past_delays(stops, model, history_days)
    asked = out.filter("hour is not null")
    for k, keys in enumerate(levels):
        needed = asked.select(F.col("b_day").alias("day"), *keys).distinct()
        stats = _quantiles_by_day(past, needed, keys, f"level{k}")
        if keys:
            stats = stats.filter(F.col("n") >= min_count)
        stats = stats.select(F.col("day").alias("s_day"), *[F.col(c).alias(f"s_{c}") for c in keys], f"level{k}")
        on = reduce(and_, [F.col(c) == F.col(f"s_{c}") for c in keys], F.col("b_day") == F.col("s_day"))
        out = out.join(stats, on, "left").drop("s_day", *[f"s_{c}" for c in keys])
    return out.withColumns({f"level{k}": F.when(F.col("hour").isNotNull(), F.col(f"level{k}")) for k in range(len(levels))}).drop("b_day", "hour")


def _array_quantiles(delays: Column) -> Column:
    """The quantiles of an array of at least MIN_COUNT delays as `percentile` has them, between the two ranks around each; else null."""

    def at(s: Column, q: float) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        return F.when(F.get(s, low) == F.get(s, high), F.get(s, low)).otherwise((high - place) * F.get(s, low) + (place - low) * F.get(s, high))

    return F.transform(F.array(F.sort_array(delays)), lambda s: F.when(F.size(s) >= MIN_COUNT, F.array(*[at(s, q) for q in QUANTILES])))[0]


#: What the finest level reads of a stop that is not asked for itself.
HISTORY = ("run_day", "train_key", "station", "planned_arr", "planned_dep", "arr_canceled", "dep_canceled", "arr_delay", "dep_delay")


def _with_finest(stops: DataFrame, asked: DataFrame, whole: bool, models: tuple[str, ...]) -> DataFrame:
    """asked with arr_0 and dep_0, the quantiles of its train at its station; null for fewer than MIN_COUNT rows.

    A stop is shuffled once, to its train and station, where it is a row that asks and one of the history of later days.
    """
    keys = LEVELS[0]
    rows = asked.withColumn("asks", F.lit(True))
    rows = rows if whole else rows.unionByName(stops.select(*HISTORY, F.lit(False).alias("asks")), allowMissingColumns=True)
    #: Rows are sorted as they were shuffled; what they tell is made of them after that.
    rows = rows.repartition(*keys).withColumn("b_num", F.unix_date(F.to_date("run_day"))).sortWithinPartitions(*keys, "b_num").withColumn("b_day", F.to_date("run_day"))
    first = F.greatest(F.date_add("b_day", 1), F.date_add(F.to_date(last_event_time()), 1))
    told = F.lit(True) if whole else ~F.col("asks")
    known = {m: F.when(F.col(f"{m}_delay").isNotNull() & ~F.col(f"{m}_canceled"), F.col(f"{m}_delay").cast("double")) for m in models}
    event = F.when(told & F.coalesce(*known.values()).isNotNull(), F.struct(first.alias("first_day"), *[c.alias(m) for m, c in known.items()]))
    days = Window.partitionBy(*keys).orderBy("b_num").rangeBetween(-HISTORY_DAYS, -1)
    out = rows.withColumn("past", F.collect_list(event).over(days)).filter("asks")
    named = reduce(and_, [F.col(c).isNotNull() for c in keys])
    past = F.filter(F.when(named & (F.size("past") >= MIN_COUNT), F.col("past")), lambda e: e["first_day"] <= F.col("b_day"))
    found = {f"{m}_0": _array_quantiles(F.array_compact(past[m])) for m in models}
    return out.withColumns(found).drop("past", "asks", "b_num")


def stop_levels(stops: DataFrame, columns: tuple[str, ...], asked: DataFrame | None = None, models: tuple[str, ...] = ("arr", "dep")) -> DataFrame:
    """columns of stops, or of those of its rows that are asked, with arr_usual, arr_overall, dep_usual, dep_overall: quantiles of the finest level and of the coarsest, as of `level_quantiles`.

    They hang on the stop alone, so requests that share a stop meet them once, with it. Stops are shuffled for the finest
    level and then to their runs, before they grow by quantiles; stations' hours are kept, both events in one table, so
    that Spark takes their size from the file when it chooses the join, and days are few.
    """
    rows = stops if asked is None else asked
    rows = rows.select(*dict.fromkeys((*columns, *HISTORY)), *[F.col(f"{m}_hour").cast("byte").alias(f"{m}_at") for m in models])
    out = _with_finest(stops, rows, asked is None, models).repartition("run_id")
    past = {m: past_delays(stops, m) for m in models}
    needed = {m: rows.select(F.to_date("run_day").alias("day"), "station", F.col(f"{m}_at").alias("hour")).filter("hour is not null") for m in models}
    both = lambda each: reduce(DataFrame.unionByName, [x.withColumn("model", F.lit(m)) for m, x in each.items()])
    hours = kept(_quantiles_by_day(both(past), both(needed), ("model", *LEVELS[1]), "q").filter(F.col("n") >= MIN_COUNT))
    for m in models:
        own = hours.filter(F.col("model") == m).select(F.col("day").alias("s_day"), F.col("station").alias("s_station"), F.col("hour").alias("s_hour"), F.col("q").alias(f"{m}_1"))
        out = out.join(own, (F.col("b_day") == F.col("s_day")) & (F.col("station") == F.col("s_station")) & (F.col(f"{m}_at") == F.col("s_hour")), "left").drop("s_day", "s_station", "s_hour")
        overall = _quantiles_by_day(past[m], needed[m].select("day"), LEVELS[2], f"{m}_2").select(F.col("day").alias("s_day"), f"{m}_2")
        out = out.join(F.broadcast(overall), F.col("b_day") == F.col("s_day"), "left").drop("s_day")
    there = lambda m, found: F.when(F.col(f"{m}_at").isNotNull(), found)
    found = {f"{m}_usual": there(m, F.coalesce(*[F.col(f"{m}_{k}") for k in range(len(LEVELS))])) for m in models} | {f"{m}_overall": there(m, F.col(f"{m}_2")) for m in models}
    return out.select(*columns, *[c.alias(n) for n, c in found.items()])


def per_day(stops: DataFrame, query: DataFrame, model: str, levels=LEVELS, **options) -> DataFrame:
    """query with q50, q80, q95 from the first level that has enough rows."""
    names = [f"level{k}" for k in range(len(levels))]
    found = level_quantiles(stops, query, model, levels, **options)
    return found.withColumns({c: F.coalesce(*names)[i] for i, c in enumerate(QCOLS)}).drop(*names)


def global_quantiles(stops: DataFrame, query: DataFrame, model: str) -> DataFrame:
    return per_day(stops, query, model, levels=((),))


def train_station_quantiles(stops: DataFrame, query: DataFrame, model: str) -> DataFrame:
    return per_day(stops, query, model)


def carry_forward(stops: DataFrame, query: DataFrame, model: str) -> DataFrame:
    """The delay last seen, with the usual spread above the median; trains not seen yet keep the usual quantiles."""
    usual = train_station_quantiles(stops, query, model)
    seen = F.col("seen_delay").cast("double")
    moved = {c: F.when(seen.isNotNull() & F.col("q50").isNotNull(), seen + (F.col(c) - F.col("q50"))).otherwise(F.col(c)).alias(c) for c in QCOLS}
    return usual.select(*[c for c in usual.columns if c not in QCOLS], *moved.values())


METHODS = {"global": global_quantiles, "train_station": train_station_quantiles, "carry_forward": carry_forward}


def by_method(methods: tuple[str, ...] = tuple(METHODS), usual: Column | None = None, overall: Column | None = None) -> Column:
    """For rows of level_quantiles, or with these quantiles, and with seen_delay: (method, q50, q80, q95) of each of the methods, as an array."""
    usual, overall, seen = F.coalesce("level0", "level1", "level2") if usual is None else usual, F.col("level2") if overall is None else overall, F.col("seen_delay").cast("double")
    moved = [F.when(seen.isNotNull(), seen + (usual[i] - usual[0])).otherwise(usual[i]) for i in range(len(QCOLS))]
    found = {"global": [overall[i] for i in range(len(QCOLS))], "train_station": [usual[i] for i in range(len(QCOLS))], "carry_forward": moved}
    return F.array(*[F.struct(F.lit(m).alias("method"), *[c.alias(n) for n, c in zip(QCOLS, found[m], strict=True)]) for m in METHODS if m in methods])


def every_method(found: DataFrame, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """The rows of level_quantiles once for each of the methods with method, q50, q80, q95."""
    rows = found.withColumn("m", F.explode(by_method(methods)))
    return rows.select(*[c for c in found.columns if not c.startswith("level")], "m.method", *[f"m.{c}" for c in QCOLS])
