"""Times and delays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.schema import PLAUSIBLE_MIN


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, truncated toward zero; null if either is null."""
    return F.timestamp_diff("MINUTE", earlier, later)


def plausible(minutes: Column, most: int = PLAUSIBLE_MIN) -> Column:
    """Null where the date must be wrong."""
    return F.when(F.abs(minutes) <= most, minutes)


def plus_minutes(time: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), time)


def actual_time(event: str) -> Column:
    """Planned time plus delay of "arr" or "dep"; null if either is null."""
    return plus_minutes(F.col(f"planned_{event}"), F.col(f"{event}_delay"))


def last_event_time() -> Column:
    """The latest of the planned and actual times; nulls are skipped."""
    return F.greatest("planned_arr", "planned_dep", actual_time("arr"), actual_time("dep"))


def day_of(time: Column) -> Column:
    """Midnight of the day, without a zone."""
    return F.to_date(time).cast("timestamp_ntz")


def minute_of_day() -> Column:
    """Clock minute of the departure, else of the arrival."""
    return F.coalesce(F.col("dep_hour") * 60 + F.col("dep_minute"), F.col("arr_hour") * 60 + F.col("arr_minute")).cast("int")
