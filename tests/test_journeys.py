"""Routes found in rounds of joins against a plain scan of each day's connections in order of departure."""

import bisect
import collections
from datetime import timedelta

from pyspark.sql import functions as F

from stellwerk.operators import requests, routing, visibility
from stellwerk.plans import relations


def scanned(conns, src, dst, depart):
    """Boarding and alighting connections of the earliest arrival, fewest boardings on ties; empty if unreachable."""
    best, came, riding = {src: (depart, 0)}, {}, {}
    for i in range(bisect.bisect_left([c.dep for c in conns], depart), len(conns)):
        c = conns[i]
        if dst in best and c.dep > best[dst][0]:
            break
        if c.station in best:
            ready, used = best[c.station]
            in_time = ready + timedelta(minutes=0 if c.station == src else 5) <= c.dep
            if in_time and (c.run_id not in riding or used + 1 < riding[c.run_id][1]):
                riding[c.run_id] = (i, used + 1)
        if c.run_id in riding and (c.next_station not in best or (c.arr, riding[c.run_id][1]) < best[c.next_station]):
            best[c.next_station] = (c.arr, riding[c.run_id][1])
            came[c.next_station] = (riding[c.run_id][0], i)
    legs, at = [], dst
    while at in came and at != src:
        legs.insert(0, came[at])
        at = conns[legs[0][0]].station
    return legs


def plain(timetables, asked, n=3):
    days = collections.defaultdict(list)
    for c in timetables.collect():
        days[c.day].append(c)
    for day in days.values():
        day.sort(key=lambda c: (c.dep, c.arr, c.run_id, c.stop_num))
    out = []
    for r in asked.collect():
        start, conns = r.depart, days[r.day]
        for route in range(n):
            legs = scanned(conns, r.src, r.dst, start)
            if not legs:
                break
            for k, (a, b) in enumerate(legs):
                on, off = conns[a], conns[b]
                out.append((r.request_id, route, k, on.run_id, on.station, on.stop_num, on.dep, off.next_station, off.next_stop_num, off.arr))
            start = conns[legs[0][0]].dep + timedelta(minutes=1)
    return sorted(out)


def found(timetables, asked):
    return sorted(tuple(r[c] for c in routing.JOURNEY) for r in routing.journeys(timetables, asked).collect())


def test_drawn_requests(spark):
    stops = relations.stops(spark, "/root/testdata/sf0.01")
    asked = requests.drawn_requests(stops, per_day=6).filter("day between '2024-01-05' and '2024-01-12'").cache()
    timetables = visibility.timetables(stops, asked).cache()
    want = plain(timetables, asked)
    assert len({x[0] for x in want}) > 30 and max(x[2] for x in want) >= 2 and max(x[1] for x in want) == 2
    assert found(timetables, asked) == want


def test_few_stations_and_ties(spark):
    """Whole hours and four stations: most arrivals are equal, runs call twice, and connections take no time."""
    stops = relations.stops(spark, "/root/testdata/sf0.001").filter("run_day < '2024-01-05'")
    stops = stops.withColumns({"station": F.concat(F.lit("T"), F.pmod(F.xxhash64("station"), F.lit(4))), **{f"planned_{e}": F.date_trunc("hour", f"planned_{e}").cast("timestamp_ntz") for e in ("arr", "dep")}})
    asked = requests.drawn_requests(stops, per_day=12).cache()
    timetables = visibility.timetables(stops, asked).cache()
    want = plain(timetables, asked)
    assert len(want) > 50 and found(timetables, asked) == want


def test_no_requests(spark):
    stops = relations.stops(spark, "/root/testdata/sf0.001")
    asked = requests.drawn_requests(stops.limit(0))
    assert routing.journeys(visibility.timetables(stops, asked), asked).count() == 0


def test_direct_hops_bound_the_search(spark):
    """Rounds get no connection that leaves after the best direct hop of all requests of its day has arrived."""
    at = "TIMESTAMP_NTZ'2024-01-05 00:00:00'"
    rows = [("a", "X", "Y", 10, 30), ("b", "X", "Z", 12, 15), ("c", "Z", "Y", 21, 26), ("d", "X", "Y", 40, 50), ("e", "Z", "Y", 31, 33), ("f", "X", "Z", 5, 8)]
    conns = spark.createDataFrame(rows, "run_id string, station string, next_station string, d int, a int")
    conns = conns.selectExpr(f"{at} as day", "run_id", "station", "1 as stop_num", "next_station", "2 as next_stop_num", f"timestampadd(MINUTE, d, {at}) as dep", f"timestampadd(MINUTE, a, {at}) as arr")
    asked = spark.sql(f"SELECT 'r' AS request_id, {at} AS day, 'X' AS src, 'Y' AS dst, timestampadd(MINUTE, 10, {at}) AS depart")
    bounds = routing.direct_bounds(conns, asked)
    assert [r.bound.minute for r in bounds.collect()] == [30]
    assert {r.run_id for r in routing.within(conns, asked, bounds).collect()} == {"a", "b", "c"}
    nowhere = asked.selectExpr("request_id", "day", "src", "'W' as dst", "depart")
    assert {r.run_id for r in routing.within(conns, nowhere, routing.direct_bounds(conns, nowhere)).collect()} == {"a", "b", "c", "d", "e"}
    found = {(r.route, r.leg): r.run_id for r in routing.journeys(conns, asked).collect()}
    assert found[0, 0] == "b" and found[0, 1] == "c"
