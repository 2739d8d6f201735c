"""Days and their edges: timetables over midnight, journeys, drawn requests, what may be learned from, contexts and predictions."""

import collections
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from stellwerk import checkpoints
from stellwerk.operators import context, model, requests, routing, sampling, visibility
from stellwerk.plans import queries, registry, relations
from stellwerk.schema import ROWS_PER_TYPE
from stellwerk.sources.stops import with_features

DAY = datetime(2031, 3, 4)
BASE = (
    "run_id string, run_day timestamp_ntz, train_type string, train_key string, line_number string, final_destination string, station string, stop_num int, "
    "planned_arr timestamp_ntz, planned_dep timestamp_ntz, arr_canceled boolean, dep_canceled boolean, arr_delay short, dep_delay short"
)


def run(name, day, kind, *halts, delay=0):
    """halts: (station, hours after the day's midnight)."""
    start, last = DAY + timedelta(days=day), len(halts)
    at = lambda h: start + timedelta(hours=h)
    return [(f"{name}@{day}", start, kind, f"{kind} {name}", None, "end", s, k, at(h) if k > 1 else None, at(h) if k < last else None, False, False, delay if k > 1 else None, delay if k < last else None)
            for k, (s, h) in enumerate(halts, 1)]


def stops_of(spark, *runs):
    return with_features(spark.createDataFrame([r for one in runs for r in one], BASE), "2031-03-10", "2031-03-20")


def test_journeys_cross_midnight(spark):
    stops = stops_of(
        spark, run("night", -1, "NJ", ("A", 20), ("B", 25), ("C", 28)), run("late", 0, "RE", ("A", 23), ("B", 24.5)), run("early", 1, "RE", ("B", 0.55), ("B2", 0.7), ("C", 2)),
        run("next", 1, "RE", ("B", 1), ("C", 3)), run("noon", 1, "RE", ("B", 12.5), ("C", 13)), run("gone", -2, "RE", ("A", 30), ("C", 31)),
    )
    asked = spark.createDataFrame([("x", DAY, "B", "C", DAY), ("y", DAY, "A", "C", DAY + timedelta(hours=22)), ("z", DAY, "C", "A", DAY)], "request_id string, day timestamp_ntz, src string, dst string, depart timestamp_ntz")
    found = collections.defaultdict(list)
    for r in sorted(routing.journeys(visibility.timetables(stops, asked), asked).collect(), key=lambda r: (r.request_id, r.route, r.leg)):
        found[r.request_id, r.route].append((r.run_id, r.from_station, r.to_station))
    #: A run of the day before is still under way after midnight; one that left at noon of the next day is beyond the window.
    assert found["x", 0] == [("night@-1", "B", "C")]
    assert [found["x", k][0][0] for k in (1, 2)] == ["early@1", "next@1"] and ("x", 3) not in found
    #: Three minutes at B are too few for the early train.
    assert found["y", 0] == [("late@0", "A", "B"), ("next@1", "B", "C")] and ("y", 1) not in found
    assert {k[0] for k in found} == {"x", "y"}


def test_timetables_are_those_of_the_days(spark):
    stops = relations.stops(spark, "/root/testdata/sf0.001").filter("run_day < '2024-01-06'")
    days = stops.select(F.col("run_day").alias("day")).distinct()
    key = lambda r: (r.run_id, r.stop_num, r.next_station, r.dep, r.arr)
    found = collections.defaultdict(set)
    for r in visibility.timetables(stops, days).collect():
        found[r.day].add(key(r))
    assert len(found) == 5
    for day in list(found)[:2]:
        assert found[day] == {key(r) for r in visibility.timetable(stops, f"{day:%Y-%m-%d}").collect()}


def test_next_departures_against_all_pairs(spark):
    conns = visibility.connections(relations.stops(spark, "/root/testdata/sf0.001")).cache()
    rows = conns.collect()
    want = {}
    for a in rows:
        later = [(b.dep, b.arr, b.run_id, b.stop_num) for b in rows if b.station == a.next_station and b.run_day == a.run_day and b.run_id != a.run_id and b.dep >= a.arr + timedelta(minutes=5)]
        if later:
            want[a.run_id, a.stop_num] = min(later)
    found = {(r.run_id, r.stop_num): (r.t.t_dep, r.t.t_arr, r.t.t_run_id, r.t.t_stop_num) for r in routing.next_departures(conns).collect()}
    assert found == want


def test_next_departure_of_another_run(spark):
    """A run that calls twice at a station is passed over, however often it leaves next."""
    stops = stops_of(spark, run("loop", 0, "S", ("A", 8), ("B", 9), ("A", 10), ("B", 11), ("C", 12)), run("x", 0, "S", ("B", 13), ("C", 14)))
    found = {(r.run_id, r.stop_num): r.t.t_run_id for r in routing.next_departures(visibility.connections(stops)).collect()}
    assert found == {("loop@0", 1): "x@0", ("loop@0", 3): "x@0"}


def test_drawn_requests(spark):
    stops = stops_of(spark, *[run(f"r{k}", 0, "S", ("A", 8), ("B" if k % 4 else "C", 9), ("D", 10)) for k in range(16)])
    found = requests.drawn_requests(stops, per_day=3400).collect()
    assert len(found) == 3400 and all(r.src != r.dst for r in found) and {r.depart.hour for r in found} == set(range(6, 23))
    assert set(collections.Counter(r.depart.hour for r in found).values()) == {200}
    share = collections.Counter(r.src for r in found)
    assert share["A"] / 3400 == pytest.approx(0.5, abs=0.03) and share["B"] / 3400 == pytest.approx(0.375, abs=0.03) and "D" not in share
    from_a = collections.Counter(r.dst for r in found if r.src == "A")
    assert from_a["B"] / sum(from_a.values()) == pytest.approx(0.75, abs=0.03)
    assert sorted(found) == sorted(requests.drawn_requests(stops, per_day=3400).collect())
    assert requests.drawn_requests(stops.filter("station = 'A'")).count() == 0 == requests.drawn_requests(stops.limit(0)).count()


def test_training_rows_do_not_leak(spark):
    stops = stops_of(
        spark, run("old", -15, "RE", ("A", 8), ("B", 9)), run("edge", -14, "RE", ("A", 8), ("B", 9)), run("night", -1, "RE", ("A", 23), ("B", 23.9), delay=20),
        run("evening", -1, "S", ("A", 22), ("B", 23)), run("today", 0, "S", ("A", 1), ("B", 2)),
    )
    days = spark.createDataFrame([(DAY,)], "day timestamp_ntz")
    assert sorted(r.run_id for r in sampling.training_rows(stops, days, "arr").collect()) == ["edge@-14", "evening@-1"]


@pytest.mark.parametrize("cap", [1, 7, 40, 300])
def test_caps(spark, cap):
    rows = spark.range(500).select("id", (F.col("id") % 3 % 2).alias("kind"), F.xxhash64("id").alias("h"))
    want = {r.id for k in (0, 1) for r in sorted((r for r in rows.collect() if r.kind == k), key=lambda r: (r.h, r.id))[:cap]}
    found = sampling.capped(rows, ["kind"], cap, F.col("h"), "id")
    assert {r.id for r in found.collect()} == want and found.columns == rows.columns
    tied = sampling.capped(rows, ["kind"], cap, F.lit(0).cast("long"), "id").collect()
    assert {r.id for r in tied} == {i for k in (0, 1) for i in sorted(i for i in range(500) if i % 3 % 2 == k)[:cap]}


@pytest.fixture(scope="module")
def week(spark):
    halts = [("A", 9), ("B", 10), ("C", 11.5), ("D", 13)]
    runs = [run("one", d, "RE", *halts, delay=abs(d)) for d in range(-9, 1)] + [run("two", d, "S", ("B", 11.4), ("C", 11.6), ("E", 12.5)) for d in range(-9, 1)]
    runs += [run("far", d, "RE", ("X", 5), ("Y", 6)) for d in range(-9, 1)] + [run("three", d, "NJ", ("B", 11.7), ("A", 11.9)) for d in range(-9, 1)]
    return stops_of(spark, *runs).cache()


def asked_at_noon(week, stop=4):
    return week.filter((F.col("run_id") == "one@0") & (F.col("stop_num") == stop)).withColumns({"request_id": F.lit("q"), "now": F.lit(DAY + timedelta(hours=12)).cast("timestamp_ntz")})


def test_context_order(week):
    """The own run's passed stops, its earlier rides, the station's last hour and that hour of earlier days, then the rest."""
    rows = context.build_context(week, asked_at_noon(week), same_train_days=3).orderBy("prio").collect()
    first = [(r.run_id, r.stop_num) for r in rows if r.grp == 0]
    assert first == [("one@0", 3), ("one@0", 2), ("one@0", 1)] and [r.prio for r in rows] == list(range(1, len(rows) + 1))
    assert [r.run_id for r in rows if r.grp == 1] == ["one@-1"] * 4 + ["one@-2"] * 4 + ["one@-3"] * 4
    assert {r.run_id.split("@")[0] for r in rows if r.grp == 4} == {"one", "far"}, "other types have no quota and S trains no part"
    noon = DAY + timedelta(hours=12)
    for r in rows:
        assert r.run_day >= DAY - timedelta(days=7) and ("one@0", 4) != (r.run_id, r.stop_num)
        for planned, delay in ((r.planned_arr, r.arr_delay), (r.planned_dep, r.dep_delay)):
            assert delay is None or planned + timedelta(minutes=delay) < noon
    assert len({(r.run_id, r.stop_num) for r in rows}) == len(rows)


def test_context_of_a_station(week):
    rows = context.build_context(week, asked_at_noon(week, 3), same_train_days=1, skip_s_bahn=False).collect()
    of = lambda g: {(r.run_id.split("@")[0], r.station) for r in rows if r.grp == g}
    #: C in the hour before 11:30 on earlier days: nothing but the own train stops there then; two calls at 11:36 today.
    assert of(2) == {("two", "C")} and all(s == "C" for _, s in of(3))


def test_context_size(week):
    rows = context.build_context(week, asked_at_noon(week), size=5).collect()
    assert sorted(r.prio for r in rows) == [1, 2, 3, 4, 5] and {r.grp for r in rows} == {0, 1}


def test_predictions_come_back_to_their_rows(week):
    """Every change in the context is known, and the own run was on time at its last stop."""
    query = asked_at_noon(week)
    (found,) = model.predict_arrivals(week, query, size=50).collect()
    assert (found.request_id, found.run_id, found.stop_num) == ("q", "one@0", 4) and found.q50 <= found.q80 <= found.q95

    def constant(c, q, quantiles):
        assert len(c) and (c["change"].notna()).all() and len(q) == 1
        return [[3.0, 1.0, 2.0]] * len(q)

    (found,) = model.predict_arrivals(week, query, size=50, backend=lambda c, q, p: __import__("numpy").array(constant(c, q, p))).collect()
    assert (found.q50, found.q80, found.q95) == (1.0, 2.0, 3.0), "in order, on top of the last known delay of 0"
    (none,) = model.predict_arrivals(week, query.withColumn("planned_arr", F.lit(None).cast("timestamp_ntz")), size=50).collect()
    assert none.q50 is None


def test_caps_do_not_broadcast_rows(spark):
    """Rows dealt to days look small to Spark, as they come from small files: only the caps of days and types go to the driver, no logs either."""
    stops = stops_of(spark, *[run("one", d, "RE", ("A", 9), ("B", 10)) for d in range(-9, 1)])
    found = sampling.training_rows(checkpoints.kept(stops), stops.select(F.col("run_day").alias("day")), "arr")
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert any("SortMergeJoin" in x and "l_run" in x for x in joins) and sum("train_type" in x for x in joins) >= 2
    assert all("day#" in x and "BuildRight" in x for x in joins if "Broadcast" in x)


def test_training_history_counts_rows_above_the_cap(spark):
    """One row more of a type than a day's training rows may have, and rows without a type or run: all are counted."""
    n = ROWS_PER_TYPE + 1
    day = F.when(F.col("id") == n + 3, F.lit(DAY)).otherwise(F.lit(DAY - timedelta(days=1))).cast("timestamp_ntz")
    known, none = F.col("id") < n, F.lit(None)
    stops = spark.range(n + 4).select(
        F.when(known, F.concat(F.lit("r"), "id")).alias("run_id"), F.lit(2).alias("stop_num"), day.alias("run_day"), F.when(known, "RE").alias("train_type"), F.timestamp_add("HOUR", F.lit(9), day).alias("planned_arr"),
        none.cast("timestamp_ntz").alias("planned_dep"), F.lit(3).cast("short").alias("arr_delay"), none.cast("short").alias("dep_delay"), F.lit(False).alias("arr_canceled"),
    )
    found = {tuple(r) for r in queries.training_history(stops).collect()}
    assert found == {(DAY, "RE", n, n, 3 * n), (DAY, None, 3, 0, 9)}


def test_training_history_by_brute_force(spark):
    """Runs whose later stops are known days after the others, or too late, types and days that differ."""
    halts = [("A", 8), ("B", 9), ("C", 23.9), ("D", 47), ("E", 24 * 14 + 5)]
    runs = [run(f"{kind}{k}", d, kind, *halts[: 2 + (k + d) % 4], delay=(k * 700 + d * 90) % 2000) for kind in ("RE", "S") for k in range(3) for d in range(-17, 3) if (k + d) % 5]
    stops = stops_of(spark, *runs)
    days = [DAY + timedelta(days=d) for d in (-3, 0, 2, 9, 40)]
    want = collections.defaultdict(list)
    for r in stops.collect():
        ends = [t + timedelta(minutes=late) for p, x in ((r.planned_arr, r.arr_delay), (r.planned_dep, r.dep_delay)) if p for t, late in ((p, 0), (p, x or 0))]
        for day in days:
            if r.arr_delay is not None and r.run_day < day <= r.run_day + timedelta(days=14) and max(ends) < day:
                want[day, r.train_type].append((r.run_id, r.arr_delay))
    found = sampling.training_history(stops, spark.createDataFrame([(d,) for d in days + days], "day timestamp_ntz"), "arr").collect()
    assert len(want) == 8 and len(found) == len(want)
    assert {(r.day, r.train_type): (r.n_rows, r.runs, r.delays) for r in found} == {k: (len(v), len({x for x, _ in v}), sum(x for _, x in v)) for k, v in want.items()}


def test_caps_keep_rows_without_a_key(spark):
    rows = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("kind"), F.xxhash64("id").alias("h"))
    found = [r.kind for r in sampling.capped(rows, ["kind"], 7, F.col("h"), "id").collect()]
    assert collections.Counter(found) == {None: 7, 1: 7, 2: 7} and sampling.capped(rows, ["kind"], 20, F.col("h"), "id").count() == 60


def test_training_history_of_odd_events(spark, tmp_path):
    """Against the SQL, where users, numbers and times are missing, users lie below 0 and delays last up to three weeks."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT event_id, CASE WHEN event_id % 41 <> 5 THEN ts END AS ts, CASE WHEN event_id % 13 <> 3 THEN user_id % 20 - 7 END AS user_id, event_type,
        CASE WHEN event_id % 17 <> 4 THEN value * (event_id % 500) END AS value, CASE WHEN event_id % 19 <> 6 THEN props END AS props FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(registry.ORACLE_SQL["training_history"])
    found = registry.QUERIES["training_history"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want.fetchall())) and any(r.train_type is None for r in found)
