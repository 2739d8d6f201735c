"""Transfer risk, outcomes, losses and report buckets as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.functions.times import minutes_between
from stellwerk.schema import CHANGE_MIN, LEVEL_CUTS

#: Train types counted as long distance.
LONG_DISTANCE = ("ICE", "IC", "EC", "ECE", "RJ", "RJX", "NJ", "EN", "FLX", "TGV", "ES")


def probability(x: Column, q50: Column, q80: Column, q95: Column) -> Column:
    """The chance that the delay is at most x: exponential tails around straight lines through the quantiles."""
    q80 = F.greatest(q80, q50 + 0.5)
    q95 = F.greatest(q95, q80 + 0.5)
    below = 0.5 * F.exp((x - q50) * math.log(2.5) / (q80 - q50))
    beyond = 1 - 0.05 * F.exp(-(x - q95) * math.log(4) / (q95 - q80))
    known = x.isNotNull() & q50.isNotNull() & q80.isNotNull() & q95.isNotNull()
    return F.when(
        known,
        F.when(x < q50, below)
        .when(x < q80, 0.5 + 0.3 * (x - q50) / (q80 - q50))
        .when(x < q95, 0.8 + 0.15 * (x - q80) / (q95 - q80))
        .otherwise(beyond),
    )


def level(p: Column) -> Column:
    """1 (almost sure) to 4 (unlikely); null for null."""
    sure, likely, open_ = LEVEL_CUTS
    return F.when(p.isNull(), None).when(p >= sure, 1).when(p >= likely, 2).when(p >= open_, 3).otherwise(4).cast("byte")


def held(canceled: Column, actual_arr: Column, actual_dep: Column) -> Column:
    """Whether a transfer worked: false if a train was canceled, null if a time is unknown."""
    return F.when(F.coalesce(canceled, F.lit(False)), False).otherwise(minutes_between(actual_dep, actual_arr) >= CHANGE_MIN)


def pinball(y: Column, predicted: Column, q: float) -> Column:
    d = y - predicted
    return F.greatest(q * d, (q - 1) * d)


def seen_case(seen: Column, minutes_ahead: Column) -> Column:
    """Not seen yet, or seen and how far ahead the event is."""
    return (
        F.when(seen.isNull(), "not seen").when(minutes_ahead <= 15, "seen, up to 15 min").when(minutes_ahead <= 60, "seen, 15 to 60 min").otherwise("seen, over 60 min")
    )


def train_group(train_type: Column) -> Column:
    return F.when(train_type.isin(*LONG_DISTANCE), "long-distance").when(train_type.isin("S", "RE", "RB"), train_type).otherwise("other")


def probability_text(p: Column) -> Column:
    """For display: rounded down to 5 %, open at both ends."""
    return F.when(p.isNull(), "no prediction").when(p >= 0.97, "97% or more").when(p < 0.05, "under 5%").otherwise(F.concat((F.floor(p * 20) * 5).cast("string"), F.lit("%")))


def short_label(label: Column) -> Column:
    """The text in closing parentheses, else the label."""
    inner = F.regexp_extract(label, r"\((.*)\)$", 1)
    return F.when(inner != "", inner).otherwise(label)
