"""From legs and predicted delays to transfer levels and ranked routes, and what really happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.risk import held, level, probability
from stellwerk.functions.times import minutes_between, plus_minutes
from stellwerk.schema import CHANGE_MIN, QCOLS

LEG = ("request_id", "route", "leg")


def _attached(legs: DataFrame, pred: DataFrame, stop: str, prefix: str) -> DataFrame:
    own = pred.select(*[F.col(c).alias(f"p_{c}") for c in ("request_id", "run_id", "stop_num")], *[F.col(c).alias(f"{prefix}_{c}") for c in QCOLS])
    on = (F.col("request_id") == F.col("p_request_id")) & (F.col("run_id") == F.col("p_run_id")) & (F.col(stop) == F.col("p_stop_num"))
    return legs.join(own, on, "left").drop("p_request_id", "p_run_id", "p_stop_num")


def with_arrival_delays(legs: DataFrame, pred: DataFrame) -> DataFrame:
    """legs with arr_q50, arr_q80, arr_q95 of the stop where they end."""
    return _attached(legs, pred, "to_stop_num", "arr")


def with_departure_delays(legs: DataFrame, pred: DataFrame) -> DataFrame:
    """legs with dep_q50, dep_q80, dep_q95 of the stop where they begin."""
    return _attached(legs, pred, "from_stop_num", "dep")


def transfers(legs: DataFrame) -> DataFrame:
    """One row per two consecutive legs: room and wait in minutes, the chance to get the train, its level.

    A late departure widens the wait, an early one does not shorten it. Legs with a method are taken apart by it.
    """
    late = F.col("dep_q50") if "dep_q50" in legs.columns else F.lit(None).cast("double")
    own = ["method"] * ("method" in legs.columns)
    route = Window.partitionBy("request_id", "route", *own).orderBy("leg")
    ahead = {"next_leg": F.col("leg"), "next_run_id": F.col("run_id"), "next_stop_num": F.col("from_stop_num"), "next_dep": F.col("dep"), "next_dep_q50": late}
    pairs = legs.withColumns({name: F.lead(c).over(route) for name, c in ahead.items()}).filter(F.col("next_leg") == F.col("leg") + 1)
    room = minutes_between(F.col("next_dep"), F.col("arr")) - CHANGE_MIN
    out = pairs.withColumn("room", room).withColumn("wait", F.col("room") + F.greatest(F.coalesce("next_dep_q50", F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("p", probability(F.col("wait"), *[F.col(f"arr_{q}") for q in QCOLS])).withColumn("level", level(F.col("p")))
    return out.select(*own, *LEG, "run_id", "to_station", "to_stop_num", "arr", "next_run_id", "next_stop_num", "next_dep", "room", "wait", "p", "level")


def routes(legs: DataFrame) -> DataFrame:
    """One row per route: planned arrival, arrival quantiles, transfers, weakest level, rank within the request.

    A route whose levels are all unknown has weakest 1, like one without transfers. Equal arrivals: fewer
    transfers first, then the route's number.
    """
    last = legs.groupBy("request_id", "route").agg(F.max_by(F.struct("arr", *[f"arr_{q}" for q in QCOLS]), "leg").alias("l"), F.min("dep").alias("dep"))
    counts = transfers(legs).groupBy("request_id", "route").agg(F.count(F.lit(1)).alias("transfers"), F.max("level").alias("weakest"))
    order = Window.partitionBy("request_id").orderBy("planned_arrival", "transfers", "route")
    return (
        last.join(counts, ["request_id", "route"], "left")
        .select(
            "request_id", "route", "dep", F.col("l.arr").alias("planned_arrival"),
            *[plus_minutes(F.col("l.arr"), F.ceil(F.col(f"l.arr_{q}"))).alias(f"arrival_{q}") for q in QCOLS],
            F.coalesce("transfers", F.lit(0)).alias("transfers"), F.coalesce("weakest", F.lit(1)).cast("int").alias("weakest"),
        )
        .withColumn("rank", F.row_number().over(order))
    )


def with_outcome(changes: DataFrame, stops: DataFrame) -> DataFrame:
    """transfers with held: what the stops say of the incoming arrival and the outgoing departure."""
    side = lambda e, p: stops.select(
        F.col("run_id").alias(f"{p}_run"), F.col("stop_num").alias(f"{p}_stop"), F.col(f"{e}_canceled").alias(f"{p}_canceled"),
        plus_minutes(F.col(f"planned_{e}"), F.col(f"{e}_delay")).alias(f"{p}_time"),
    )
    out = changes.join(side("arr", "i"), (F.col("run_id") == F.col("i_run")) & (F.col("to_stop_num") == F.col("i_stop")), "left")
    out = out.join(side("dep", "o"), (F.col("next_run_id") == F.col("o_run")) & (F.col("next_stop_num") == F.col("o_stop")), "left")
    canceled = F.coalesce("i_canceled", F.lit(False)) | F.coalesce("o_canceled", F.lit(False))
    out = out.withColumn("canceled", canceled).withColumn("held", held(canceled, F.col("i_time"), F.col("o_time")))
    return out.drop("i_run", "i_stop", "o_run", "o_stop", "i_canceled", "o_canceled", "i_time", "o_time")
