"""The stops relation: built from raw monthly rows, or derived from the events table; readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellwerk.functions.times import day_of, minutes_between, plausible
from stellwerk.schema import STOPS

#: Types that are no trains, and types without a stable history.
NON_TRAIN = "(?i)^(?:bus|sev|bsv)$"
DROP_TYPES = (
    "DB", "PRE", "MBB", "P", "SDG", "DPN", "ÖBA", "KTB", "UEF",
    "DRC-L", "DRC", "CLB", "Bvs", "L-S", "DBK", "MSM", "RBP", "DRB-G", "SPNV", "SVG", "LEO", "Sp",
    "RE1", "RE 4", "2", ".",
)
RAW = (
    "id", "station_name", "xml_station_name", "eva", "train_number", "line_number", "final_destination_station", "train_type",
    "is_replacement_train", "is_additional_stop", "arrival_is_canceled", "departure_is_canceled", "train_line_station_num",
    "arrival_planned_time", "arrival_change_time", "departure_planned_time", "departure_change_time",
)


#: Those of RAW that are times.
RAW_TIMES = RAW[-4:]


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """Monthly raw files, only the columns that are used; times as timestamp_ntz, whatever unit each month stores.

    Spark has no type for nanoseconds, so they are read as numbers, a session setting that other Parquet files do not
    notice; months are read by their own schemas and united by name.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    months = []
    for path in paths:
        month = spark.read.parquet(path).select(*RAW)
        kinds = dict(month.dtypes)
        micros = lambda c: F.expr(f"timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(cast(floor(`{c}` / 1000) as decimal(20, 0)) / 1000000 as decimal(18, 6)))")
        months.append(month.withColumns({c: micros(c) if kinds[c] == "bigint" else F.col(c).cast("timestamp_ntz") for c in RAW_TIMES}))
    return reduce(DataFrame.unionByName, months)


def raw_rows(spark: SparkSession, *paths: str) -> int:
    """How many rows the raw files have; no column is read."""
    return spark.read.parquet(*paths).count()


def trains(raw: DataFrame) -> DataFrame:
    """Raw rows of regular trains with run_id, run_day and station; the id is <ride>-<yyMMddHHmm>-<stop>."""
    part = lambda pattern: F.nullif(F.regexp_extract("id", pattern, 1), F.lit(""))
    return (
        raw.filter(
            F.col("train_type").isNotNull() & ~F.col("train_type").rlike(NON_TRAIN) & ~F.col("train_type").isin(*DROP_TYPES)
            & ~F.col("is_replacement_train") & ~F.col("is_additional_stop")
            & (F.col("arrival_planned_time").isNotNull() | F.col("departure_planned_time").isNotNull())
        )
        .withColumn("run_id", part(r"^(.*-\d{10})-\d+$"))
        .withColumn("run_day", F.to_timestamp_ntz(part(r"-(\d{6})\d{4}-\d+$"), F.lit("yyMMdd")))
        .withColumn("station", F.coalesce("station_name", F.concat(F.lit("EVA "), F.col("eva").cast("string"))))
        .drop("id")
    )


def translated_destination(rows: DataFrame) -> DataFrame:
    """rows with final_destination spelled like the stations: by the xml names that belong to one station only.

    Nulls match nulls; places that are no station keep their spelling, empty ones are the station itself.
    """
    names = rows.select(F.col("xml_station_name").alias("xml"), F.col("station").alias("translated")).distinct()
    names = names.groupBy("xml").agg(F.count(F.lit(1)).alias("n"), F.min("translated").alias("translated")).filter("n = 1").drop("n")
    joined = rows.join(names, F.col("final_destination_station").eqNullSafe(F.col("xml")), "left")
    return joined.withColumn("final_destination", F.coalesce("translated", "final_destination_station", "station")).drop("xml", "translated")


def prepare(raw: DataFrame, first_day: str, last_day: str, validation_start: str, test_start: str) -> DataFrame:
    """The stops relation of the runs that start from first_day to last_day."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = translated_destination(trains(raw).filter(F.col("run_day").between(day(first_day), day(last_day))))
    delay = lambda e: F.when(~F.col(f"{e}_is_canceled"), plausible(minutes_between(F.col(f"{e}_change_time"), F.col(f"{e}_planned_time")))).cast("short")
    base = rows.select(
        "run_id", "run_day", "train_type", F.concat("train_type", F.lit(" "), F.col("train_number").cast("string")).alias("train_key"), "line_number", "final_destination",
        "station", F.col("train_line_station_num").cast("int").alias("stop_num"), F.col("arrival_planned_time").alias("planned_arr"), F.col("departure_planned_time").alias("planned_dep"),
        F.col("arrival_is_canceled").alias("arr_canceled"), F.col("departure_is_canceled").alias("dep_canceled"), delay("arrival").alias("arr_delay"), delay("departure").alias("dep_delay"),
    )
    return with_features(base, validation_start, test_start)


def with_features(base: DataFrame, validation_start: str, test_start: str) -> DataFrame:
    """Adds what depends on the neighbours in the run, the calendar and the split; one shuffle by run."""
    in_run = Window.partitionBy("run_id")
    by_stop = in_run.orderBy(F.asc_nulls_last("stop_num"))
    adjacent = F.col("run_id").isNotNull() & (F.col("stop_num") - F.lag("stop_num").over(by_stop) == 1)
    number = lambda part, c: part(c).cast("double")
    out = base.withColumns(
        {
            "prev_station": F.when(adjacent, F.lag("station").over(by_stop)),
            "run_planned_min": F.when(adjacent, plausible(minutes_between(F.col("planned_arr"), F.lag("planned_dep").over(by_stop)))).cast("short"),
            "dwell_planned_min": minutes_between(F.col("planned_dep"), F.col("planned_arr")).cast("short"),
            "n_stops": F.max("stop_num").over(in_run),
        }
    ).withColumns(
        {
            "stop_frac": F.col("stop_num") / F.col("n_stops"),
            "arr_hour": number(F.hour, "planned_arr"), "arr_minute": number(F.minute, "planned_arr"),
            "dep_hour": number(F.hour, "planned_dep"), "dep_minute": number(F.minute, "planned_dep"),
            "weekday": (F.weekday(F.coalesce("planned_dep", "planned_arr")) + 1).cast("byte"),
            "split": split_of(F.col("run_day"), validation_start, test_start),
        }
    )
    return out.select(*[c.split()[0] for c in STOPS.split(", ")])


def split_of(day: Column, validation_start: str, test_start: str) -> Column:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return F.when(day < at(validation_start), "context").when(day < at(test_start), "validation").otherwise("test")


def repeated_keys(stops: DataFrame) -> DataFrame:
    """Keys (run_id, stop_num) that occur more than once; a stops relation has none."""
    return stops.groupBy("run_id", "stop_num").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def write(stops: DataFrame, path: str) -> None:
    """zstd Parquet, one folder a day, so that day filters prune files."""
    stops.withColumn("day", F.to_date("run_day")).write.option("compression", "zstd").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save(stops: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A table of zstd Parquet below path: one folder a day, in it one file for each bucket of runs, sorted by run and stop.

    Windows and joins by run_id that start from the table need no exchange, and day filters prune folders. Rows are dealt
    to buckets once, as the table is written.
    """
    dealt = stops.withColumn("day", F.to_date("run_day")).repartition(buckets, "run_id")
    dealt.write.option("compression", "zstd").option("path", path).partitionBy("day").bucketBy(buckets, "run_id").sortBy("run_id", "stop_num").saveAsTable(table)
    return stops.sparkSession.table(table)


def from_events(spark: SparkSession, sf_dir: str, validation_start: str = "2024-01-17", test_start: str = "2024-01-24") -> DataFrame:
    """Stops derived from the events table: a run is a user's day, its stops are the events by time; one shuffle, by run."""
    run = Window.partitionBy("run_id", "user_id", "d")
    run_id = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))
    #: Only what the stops are made of is shuffled, as numbers.
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", (F.col("event_type") == "error").alias("error"), (F.floor(F.col("value") / 10) - 1).cast("int").alias("base"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    rows = rows.repartition(run_id).withColumns({"run_id": run_id, "d": F.to_date("ts"), "m": F.date_trunc("minute", "ts").cast("timestamp_ntz")})
    rows = rows.withColumns({"stop_num": F.row_number().over(run.orderBy("ts", "event_id")), "last": F.count(F.lit(1)).over(run).cast("int")})
    #: None without a user: element_at alone takes the last type for a missing place, and fails for place 0, of users below 0.
    train_type = F.when(F.col("user_id") % 5 != -1, F.element_at(F.array(*map(F.lit, ("ICE", "RE", "RB", "S", "NJ"))), (F.col("user_id") % 5 + 1).cast("int")))
    arrives, departs = F.col("stop_num") > 1, F.col("stop_num") < F.col("last")
    error, base = F.col("error"), F.col("base")
    rows = rows.withColumns({"arr_canceled": arrives & error & (F.col("k") % 5 == 0), "dep_canceled": departs & error & (F.col("k") % 7 == 0), "train_type": train_type})
    stops = rows.select(
        "run_id", day_of(F.col("d")).alias("run_day"), "train_type",
        F.concat("train_type", F.lit(" "), F.col("user_id").cast("string")).alias("train_key"), F.lit(None).cast("string").alias("line_number"), F.lit(None).cast("string").alias("final_destination"),
        F.concat(F.lit("ST"), F.floor(F.sqrt("k")).cast("string")).alias("station"), "stop_num", F.when(arrives, F.col("m")).alias("planned_arr"),
        F.when(departs, F.timestamp_add("MINUTE", F.lit(2), F.col("m"))).alias("planned_dep"), "arr_canceled", "dep_canceled",
        F.when(arrives & ~F.col("arr_canceled"), base).cast("short").alias("arr_delay"), F.when(departs & ~F.col("dep_canceled"), base + F.col("k") % 3).cast("short").alias("dep_delay"),
    )
    return with_features(stops, validation_start, test_start)
