"""Transfer risk, ranks and outcomes on a trip from Nord to Süd, with values worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stellwerk.functions.risk import level, probability
from stellwerk.operators import risk

LEGS = "request_id long, route long, leg long, run_id string, from_station string, from_stop_num int, dep timestamp_ntz, to_station string, to_stop_num int, arr timestamp_ntz"
PRED = "request_id long, run_id string, stop_num int, q50 double, q80 double, q95 double"
EIGHT = datetime(2031, 3, 4, 8)


def clock(minutes):
    return EIGHT + timedelta(minutes=minutes)


#: Seven minutes at Mitte, of which two are needed to change, or a direct train.
VIA = [(5, 0, 0, "blue", "Nord", 2, clock(20), "Mitte", 4, clock(55)), (5, 0, 1, "green", "Mitte", 1, clock(62), "Süd", 6, clock(100))]
DIRECT = (5, 1, 0, "red", "Nord", 3, clock(25), "Süd", 8, clock(110))


def trip(spark, rows, blue):
    pred = spark.createDataFrame([(5, "blue", 4, *blue), (5, "green", 6, 2.0, 2.5, 7.0), (5, "red", 8, -1.0, 0.0, 1.0)], PRED)
    return risk.with_arrival_delays(spark.createDataFrame(rows, LEGS), pred)


@pytest.mark.parametrize(
    ("blue", "p", "want"), [((0.0, 2.0, 3.0), 1 - 0.05 / 16, 1), ((2.0, 4.0, 10.0), 0.825, 2), ((2.0, 8.0, 9.0), 0.65, 3), ((7.0, 9.0, 12.0), 0.2, 4), ((None, None, None), None, None)]
)
def test_chance_of_a_change(spark, blue, p, want):
    (found,) = risk.transfers(trip(spark, [*VIA, DIRECT], blue)).collect()
    assert (found.room, found.wait, found.level) == (5, 5, want) and found.p == (pytest.approx(p) if p else None)


@pytest.mark.parametrize(("late", "wait", "p"), [(3.0, 8, 0.8), (-4.0, 5, 0.65), (None, 5, 0.65)])
def test_only_a_late_departure_moves_the_wait(spark, late, wait, p):
    green = spark.createDataFrame([(5, "green", 1, late, late, late)], PRED)
    (found,) = risk.transfers(risk.with_departure_delays(trip(spark, VIA, (2.0, 8.0, 9.0)), green)).collect()
    assert found.wait == wait and found.p == pytest.approx(p)


def test_methods_do_not_mix(spark):
    legs = [trip(spark, VIA, q).withColumn("method", F.lit(m)) for m, q in (("sharp", (0.0, 2.0, 3.0)), ("wide", (7.0, 9.0, 12.0)))]
    assert sorted((r.method, r.level) for r in risk.transfers(legs[0].unionByName(legs[1])).collect()) == [("sharp", 1), ("wide", 4)]


@pytest.mark.parametrize("q", [(-3.0, -1.0, 6.0), (4.0, 4.0, 4.0)])
def test_chance_grows_with_the_wait(spark, q):
    x = spark.range(-120, 100).select((F.col("id") / 8).alias("x"))
    p = [r.p for r in x.select("x", probability(F.col("x"), *map(F.lit, q)).alias("p")).orderBy("x").collect()]
    assert p[0] > 0 and p[-1] < 1 and all(b > a for a, b in zip(p, p[1:], strict=False))
    assert p[round(8 * q[0]) + 120] == pytest.approx(0.5)


def test_levels_begin_at_their_cuts(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate((1.0, 0.97, 0.9699, 0.8, 0.7999, 0.5, 0.4999, 0.0, None))], "k int, p double")
    assert [r.l for r in rows.select("k", level(F.col("p")).alias("l")).orderBy("k").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, None]


@pytest.mark.parametrize(("direct", "order"), [(110, [0, 1]), (100, [1, 0]), (95, [1, 0])])
def test_earlier_then_fewer_changes(spark, direct, order):
    found = risk.routes(trip(spark, [*VIA, (*DIRECT[:9], clock(direct))], (0.0, 2.0, 3.0))).orderBy("rank").collect()
    assert [r.route for r in found] == order
    assert {r.route: (r.transfers, r.weakest, r.arrival_q80) for r in found} == {0: (1, 1, clock(103)), 1: (0, 1, clock(direct))}


def test_a_gap_between_legs_is_no_change(spark):
    assert risk.transfers(trip(spark, [VIA[0], (5, 0, 3, *VIA[1][3:])], (0.0, 2.0, 3.0))).count() == 0


def test_what_happened(spark):
    schema = "run_id string, stop_num int, planned_arr timestamp_ntz, arr_delay int, arr_canceled boolean, planned_dep timestamp_ntz, dep_delay int, dep_canceled boolean"
    cases = [("on time", 5, False, 0, False, True), ("a minute short", 6, False, 0, False, False), ("waited for", 14, False, 10, False, True), ("no arrival", None, True, 0, False, False),
             ("no departure", 0, False, None, True, False), ("unknown", None, False, 0, False, None)]
    rows = [(f"in {n}", 4, clock(55), a, c, None, None, False) for n, a, c, *_ in cases] + [(f"out {n}", 1, None, None, False, clock(62), d, x) for n, _, _, d, x, _ in cases]
    changes = spark.createDataFrame([(f"in {n}", 4, f"out {n}", 1) for n, *_ in cases], "run_id string, to_stop_num int, next_run_id string, next_stop_num int")
    found = {r.run_id[3:]: r.held for r in risk.with_outcome(changes, spark.createDataFrame(rows, schema)).collect()}
    assert found == {n: held for n, *_, held in cases}
