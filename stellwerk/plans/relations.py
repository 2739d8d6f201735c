"""Relations that several queries start from, derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.checkpoints import kept
from stellwerk.operators import baselines, routing, visibility
from stellwerk.operators.requests import leg_sides, request_rows
from stellwerk.schema import QCOLS
from stellwerk.sources.stops import from_events

NOW = "2024-01-20 14:00:00"


def at(time: str):
    return F.lit(time).cast("timestamp_ntz")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(from_events(spark, sf_dir))


def legs(stops: DataFrame) -> DataFrame:
    """Legs of direct hops and next-departure transfers of every day."""
    return kept(routing.two_leg_legs(visibility.connections(stops)))


def requests(legs: DataFrame) -> DataFrame:
    return legs.groupBy("request_id").agg(F.min("dep").alias("depart"))


#: What rows and scores read of a stop.
ASKED = ("run_id", "stop_num", "train_type", "planned_arr", "planned_dep", "arr_delay", "dep_delay")


def _asked(stops: DataFrame, read: DataFrame) -> DataFrame:
    """Rows of read (of stops) that legs ask for. No numbers of routes are needed: legs are not laid in order."""
    own = routing.two_leg_routes(visibility.connections(stops)).select("request_id", F.explode("legs").alias("l"))
    own = kept(own.select("request_id", "l.run_id", "l.from_stop_num", "l.to_stop_num", "l.dep"))
    return request_rows(read, kept(requests(own)), own)


def rows(stops: DataFrame) -> DataFrame:
    return _asked(stops, stops.select(*ASKED))


def predicted(stops: DataFrame) -> DataFrame:
    """rows with method and the quantiles of every method. They are read once, so they are not kept."""
    found = _asked(stops, baselines.stop_levels(stops, ASKED))
    own = lambda c: F.when(F.col("model") == "dep", F.col(f"dep_{c}")).otherwise(F.col(f"arr_{c}"))
    found = found.withColumns({"usual": own("usual"), "overall": own("overall")})
    found = found.withColumn("m", F.explode(baselines.by_method(usual=F.col("usual"), overall=F.col("overall"))))
    return found.select("request_id", "run_id", "stop_num", "model", "case", "group", "weight", "delay", "m.method", *[f"m.{c}" for c in QCOLS])


def legs_with_delays(stops: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """legs once for each method, with the arrival delays it predicts; departure delays are those last seen, whatever the method."""
    own = legs(stops)
    return delayed(stops, None, own, kept(requests(own)), methods)


def delayed(stops: DataFrame, asked: DataFrame | None, own: DataFrame, requests: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """The same for given legs of requests (request_id, depart), whose runs' stops are asked (None: all stops): a leg meets its run once, with the predictions of both sides and all methods."""
    found = leg_sides(baselines.stop_levels(stops, tuple(c for c in ASKED if c != "train_type"), asked), requests, own)
    told = baselines.by_method(methods, F.col("off.arr_usual"), F.col("off.arr_overall"))
    seen = baselines.by_method(("carry_forward",), F.col("on.dep_usual"), F.col("on.dep_overall"))[0]
    #: Routes and transfers both read it.
    found = kept(found.select(*own.columns, told.alias("told"), seen.alias("seen")))
    return found.select(*own.columns, *[F.col("seen")[c].alias(f"dep_{c}") for c in QCOLS], F.explode("told").alias("m")).select(
        *own.columns, *[f"dep_{c}" for c in QCOLS], "m.method", *[F.col("m")[c].alias(f"arr_{c}") for c in QCOLS]
    )
