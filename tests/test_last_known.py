"""What is known of a run at a moment, against a plain reading of its events."""

import collections
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stellwerk.operators.visibility import at_cutoff, known_at, last_seen, run_logs, with_last_known
from stellwerk.plans import relations
from stellwerk.streaming.last_known import last_known_stream

SCHEMA = "run_id string, run_day timestamp_ntz, stop_num int, planned_arr timestamp_ntz, planned_dep timestamp_ntz, arr_delay int, dep_delay int"
DAY = datetime(2031, 3, 4)
#: Planned minutes after six, and delays, of each stop; the third stop of the ferry was left out by its skipper.
RUNS = {
    ("ferry", 0): [(None, 0, None, 1), (25, 27, 3, 3), (40, 41, None, None), (70, 75, 20, 16), (90, None, 9, None)],
    ("ferry", -1): [(None, 0, None, 0), (25, 27, 8, 7), (40, 41, 6, 6), (70, 75, 2, 2), (90, None, 1, None)],
    ("tram", 0): [(None, 30, None, 0), (30, 30, 0, 0), (61, None, 2, None)],
}


def moment(day, minutes):
    return None if minutes is None else DAY + timedelta(days=day, hours=6, minutes=minutes)


def rows():
    return [(f"{n}{d}", DAY + timedelta(days=d), k, moment(d, a), moment(d, p), x, y) for (n, d), plan in RUNS.items() for k, (a, p, x, y) in enumerate(plan, 1)]


@pytest.fixture(scope="module")
def stops(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def expected(run, stop, model, now, replay):
    """The last event before the cutoff at an earlier stop, or the arrival at the same one for a departure."""
    own = next(r for r in rows() if (r[0], r[2]) == (run, stop))
    planned, delay = (own[3], own[5]) if model == "arr" else (own[4], own[6])
    cut = now
    if replay:
        cut = min(x for x in (now, planned.replace(hour=now.hour, minute=now.minute), delay is not None and planned + timedelta(minutes=delay)) if x)
    events = [(t + timedelta(minutes=d), k, e, t, d) for r, _, k, a, p, x, y in rows() if r == run for e, t, d in ((0, a, x), (1, p, y)) if t and d is not None]
    seen = [v for v in events if v[0] < cut and (v[1] < stop or (model == "dep" and v[1] == stop and v[2] == 0))]
    if not seen:
        return (None, None, None)
    _, k, _, t, d = max(seen)
    return d, int((planned - t).total_seconds() // 60), stop - k


@pytest.mark.parametrize("model", ["arr", "dep"])
@pytest.mark.parametrize("replay", [False, True])
@pytest.mark.parametrize("minutes", [0, 1, 28, 30, 60, 91, 300])
def test_last_known(stops, model, replay, minutes):
    now = moment(0, minutes)
    found = with_last_known(stops.filter(f"planned_{model} is not null"), stops, F.lit(now).cast("timestamp_ntz"), model, replay).collect()
    assert len(found) == 10
    for r in found:
        assert (r.last_known_delay, r.minutes_since_known, r.stops_since_known) == expected(r.run_id, r.stop_num, model, now, replay), r


def test_an_event_at_the_moment_itself_is_not_known(stops):
    at = lambda m: {(r.run_id, r.stop_num): (r.arr_delay, r.dep_delay) for r in known_at(stops.filter("run_day >= '2031-03-04'"), F.lit(moment(0, m)).cast("timestamp_ntz")).collect()}
    assert at(28) == {("ferry0", 1): (None, 1)}
    assert at(29) == {("ferry0", 1): (None, 1), ("ferry0", 2): (3, None)}


def test_last_seen_takes_any_stop(spark, stops):
    asked = spark.createDataFrame([("a", "ferry0", moment(0, 91)), ("b", "ferry0", moment(0, 1)), ("c", "tram0", moment(0, 31))], "request_id string, run_id string, now timestamp_ntz")
    assert {r.request_id: r.seen_delay for r in last_seen(stops, asked).collect()} == {"a": 20, "b": None, "c": 0}


def test_stream_and_table_agree(spark, tmp_path):
    schema = "run_id string, time timestamp, index int, is_arr boolean, delay int"
    rows = [(r, datetime(2031, 3, 4, 6, m), m, m % 2 == 0, d) for r, m, d in (("a", 5, 1), ("a", 50, 4), ("b", 10, 2), ("a", 50, 9))]
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(f"{tmp_path}/in")
    query = last_known_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = sorted((r.run_id, r.delay) for r in spark.table("seen").collect())
    assert found == sorted((r.run_id, r.delay) for r in last_known_stream(spark.createDataFrame(rows, schema)).collect())
    assert [k for k, _ in found] == ["a", "b"] and dict(found)["b"] == 2


@pytest.mark.parametrize("model", ["arr", "dep"])
def test_logs_in_and_out_of_order(spark, model):
    """Cutoffs all over the day, against a plain search through the run's events."""
    stops = relations.stops(spark, "/root/testdata/sf0.001").withColumn("dep_delay", F.when(F.col("stop_num") % 5 == 2, F.lit(300).cast("short")).otherwise(F.col("dep_delay")))
    order = collections.Counter(r.in_order for r in run_logs(stops).collect())
    assert order[True] > 20 and order[False] > 20
    asked = stops.filter(f"planned_{model} is not null").withColumn("cut", F.timestamp_add("MINUTE", F.pmod(F.xxhash64("run_id", "stop_num"), F.lit(1440)).cast("int"), "run_day"))
    runs = collections.defaultdict(list)
    for r in stops.collect():
        runs[r.run_id].append(r)
    for r in at_cutoff(asked, stops, F.col("cut"), model).collect():
        own = sorted((x for x in runs[r.run_id] if x.planned_arr or x.planned_dep), key=lambda x: (x.planned_arr or x.planned_dep, x.stop_num))
        at = [x.stop_num for x in own].index(r.stop_num)
        log = [(x[f"planned_{e}"] + timedelta(minutes=x[f"{e}_delay"]), k, e == "dep", x[f"planned_{e}"], x[f"{e}_delay"]) for k, x in enumerate(own) for e in ("arr", "dep") if x[f"planned_{e}"] and x[f"{e}_delay"] is not None]
        last = max((x for x in log if x[0] < r.cut and (x[1] < at or (model == "dep" and x[1] == at and not x[2]))), default=None)
        want = (None, None, None) if last is None else (last[4], int((r[f"planned_{model}"] - last[3]) / timedelta(minutes=1)), at - last[1])
        assert (r.last_known_delay, r.minutes_since_known, r.stops_since_known) == want
