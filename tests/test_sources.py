"""Raw months, stored stops and stored results."""

import io
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stellwerk.operators import visibility
from stellwerk.plans import relations
from stellwerk.sources import cache, stops

SF = "/root/testdata/sf0.001"
NOON = datetime(2031, 5, 10, 12)


def raw(name="4-3105101100-1", **other):
    """One raw row that every rule keeps."""
    row = dict(
        id=name, station_name="Ulm Hbf", xml_station_name="Ulm", eva=8, train_number=77, line_number="5", final_destination_station="Aue", train_type="RE", is_replacement_train=False,
        is_additional_stop=False, arrival_is_canceled=False, departure_is_canceled=False, train_line_station_num=int(name.rsplit("-", 1)[1]) if "-" in name else 1,
        arrival_planned_time=NOON, arrival_change_time=NOON + timedelta(minutes=4), departure_planned_time=NOON + timedelta(minutes=2), departure_change_time=NOON + timedelta(minutes=5),
    )
    assert set(row) == set(stops.RAW) and set(other) <= set(row)
    return row | other


def month(path, unit, *rows):
    """A raw file with its times in this unit, and a column that is not used."""
    times = pa.timestamp(unit)
    kinds = {c: times for c in stops.RAW_TIMES} | {c: pa.bool_() for c in stops.RAW if "is_" in c} | {"eva": pa.int64(), "train_number": pa.int64(), "train_line_station_num": pa.int64()}
    table = pa.table({c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in stops.RAW} | {"unused": pa.array([1] * len(rows))})
    pq.write_table(table, path)
    return str(path)


def prepared(spark, *paths):
    return {r.run_id + f"-{r.stop_num}": r for r in stops.prepare(stops.read_raw(spark, *paths), "2031-05-10", "2031-05-11", "2031-05-11", "2031-05-20").collect()}


def test_months_of_other_units(spark, tmp_path):
    """Nanoseconds, microseconds and milliseconds, and times before 1970, come out alike."""
    old = datetime(1969, 12, 31, 23, 59, 59, 500_000)
    paths = [month(tmp_path / f"{unit}.parquet", unit, raw(), raw("5-3105101100-2", arrival_planned_time=old, departure_planned_time=None)) for unit in ("ns", "us", "ms")]
    found = stops.read_raw(spark, *paths)
    assert {t for c, t in found.dtypes if c in stops.RAW_TIMES} == {"timestamp_ntz"} and stops.raw_rows(spark, *paths) == 6
    assert {(r.id, r.arrival_planned_time, r.departure_planned_time) for r in found.collect()} == {("4-3105101100-1", NOON, NOON + timedelta(minutes=2)), ("5-3105101100-2", old, None)}


DROPPED = {
    "a bus": dict(train_type="bUs"), "a replacement bus": dict(train_type="SEV"), "a short-lived type": dict(train_type="DPN"), "no type": dict(train_type=None), "a replacement": dict(is_replacement_train=True),
    "an extra stop": dict(is_additional_stop=True), "no planned time": dict(arrival_planned_time=None, departure_planned_time=None),
}


@pytest.mark.parametrize("unit", ["ns", "us"])
def test_rules_of_rows(spark, tmp_path, unit):
    """Each rule has a row that passes and one that fails."""
    rows = [raw("4-3105101100-1"), raw("4-3105101100-2", departure_planned_time=None, departure_change_time=None)]
    rows += [raw(f"9{k}-3105101100-1", **change) for k, change in enumerate(DROPPED.values())]
    rows += [raw("7-3105092359-1"), raw("7-3105120000-1"), raw("7-3105112359-1"), raw("no id")]
    rows += [raw("8-3105101100-1", train_type="Busse"), raw("8-3105101200-3", station_name=None)]
    found = prepared(spark, month(tmp_path / "raw.parquet", unit, *rows))
    assert set(found) == {"4-3105101100-1", "4-3105101100-2", "7-3105112359-1", "8-3105101100-1", "8-3105101200-3"}
    first, last = found["4-3105101100-1"], found["4-3105101100-2"]
    assert (first.run_day, first.split, first.train_key, first.station, first.arr_delay, first.dep_delay, first.dwell_planned_min) == (datetime(2031, 5, 10), "context", "RE 77", "Ulm Hbf", 4, 3, 2)
    assert (last.n_stops, last.prev_station, last.run_planned_min, last.dep_delay, last.dep_hour, last.weekday) == (2, "Ulm Hbf", -2, None, None, 6)
    assert found["8-3105101200-3"].station == "EVA 8" and found["8-3105101200-3"].prev_station is None
    assert found["7-3105112359-1"].split == "validation"


def test_rules_of_delays(spark, tmp_path):
    at = lambda minutes: NOON + timedelta(minutes=minutes)
    rows = [
        raw("1-3105101100-1", arrival_change_time=at(1200)), raw("1-3105101100-2", arrival_change_time=at(1201)), raw("1-3105101100-3", arrival_change_time=at(-1200)), raw("1-3105101100-4", arrival_change_time=at(-1201)),
        raw("1-3105101100-5", arrival_is_canceled=True), raw("1-3105101100-6", arrival_change_time=None), raw("1-3105101100-7", arrival_change_time=NOON - timedelta(seconds=90)),
        raw("1-3105101100-8", arrival_change_time=NOON + timedelta(seconds=119)),
    ]
    found = prepared(spark, month(tmp_path / "raw.parquet", "ns", *rows))
    assert [found[f"1-3105101100-{k}"].arr_delay for k in range(1, 9)] == [1200, None, -1200, None, None, None, -1, 1]
    assert found["1-3105101100-5"].arr_canceled and found["1-3105101100-5"].dep_delay == 3


def test_rules_of_destinations(spark, tmp_path):
    """Spelled like the station where one station has the name; two stations, or none, leave it; an empty one is the station."""
    rows = [
        raw("1-3105101100-1", station_name="Aue (Sachsen)", xml_station_name="Aue(Sachs)"), raw("1-3105101100-2", final_destination_station="Aue(Sachs)"),
        raw("2-3105101100-1", station_name="Hof A", xml_station_name="Hof"), raw("2-3105101100-2", station_name="Hof B", xml_station_name="Hof", final_destination_station="Hof"),
        raw("3-3105101100-1", final_destination_station="Basel"), raw("3-3105101100-2", final_destination_station=None),
    ]
    found = prepared(spark, month(tmp_path / "raw.parquet", "us", *rows))
    assert [found[f"{k}-3105101100-2"].final_destination for k in (1, 2, 3)] == ["Aue (Sachsen)", "Hof", "Ulm Hbf"] and found["3-3105101100-1"].final_destination == "Basel"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_stored_by_day(spark, tmp_path):
    rows = relations.stops(spark, SF)
    stops.write(rows, str(tmp_path / "s"))
    found = stops.read(spark, str(tmp_path / "s"))
    assert sorted(map(str, found.drop("day").collect())) == sorted(map(str, rows.collect()))
    assert "PartitionFilters: [isnotnull(day" in plan(found.filter("day = date'2024-01-05'"))


def test_stored_by_run(spark, tmp_path):
    """What works run by run starts from the buckets without an exchange, and reads the asked days only."""
    rows = relations.stops(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = stops.save(rows, "stored_stops", str(tmp_path / "t"), 4)
        day = table.filter("day = date'2024-01-05'")
        assert sorted(map(str, table.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
        for work, source in ((visibility.connections(table), rows), (visibility.run_logs(table), rows), (visibility.connections(day), rows.filter("run_day = '2024-01-05'"))):
            assert "hashpartitioning" not in plan(work)
            same = visibility.run_logs(source) if "log" in work.columns else visibility.connections(source)
            assert sorted(map(str, work.select(same.columns).collect())) == sorted(map(str, same.collect()))
        assert "PartitionFilters: [isnotnull(day" in plan(visibility.connections(day))
        joined = table.join(visibility.run_logs(table).select("run_id", F.size("log").alias("events")), "run_id")
        assert "hashpartitioning" not in plan(joined) and joined.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS stored_stops")


RESULT = "method string, request_id string, q50 double"


def test_results_of_a_killed_write(spark, tmp_path):
    """A write that never reached its manifest, then repeated, and repeated again: each key is there once."""
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("m", f"k{k}", float(k)) for k in range(20)], RESULT)
    assert cache.read(spark, path) is None and cache.pending(rows, path, "request_id").count() == 20
    cache.add(rows.limit(5), path)
    rows.filter("request_id > 'k5'").write.parquet(f"{path}/batch=killed")
    assert cache.read(spark, path).count() == 5
    for _ in range(2):
        cache.add(rows, path)
        found = cache.read(spark, path)
        assert found.columns == rows.columns and sorted(found.collect()) == sorted(rows.collect())
    assert cache.pending(rows, path, "request_id").count() == 0
    assert cache.sweep(spark, path) == ["killed"] and cache.sweep(spark, path) == [] and cache.read(spark, path).count() == 20


def test_methods_are_folders(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(m, f"k{k}", float(k)) for k in range(4) for m in ("a", "b")], RESULT)
    cache.add(rows.filter("method = 'a'"), path, "method", "request_id", partition_by=("method",))
    cache.add(rows.withColumn("more", F.lit(1)), path, "method", "request_id", partition_by=("method",))
    found = cache.read(spark, path)
    assert sorted(found.select(rows.columns).collect()) == sorted(rows.collect())
    assert {(r.method, r.more) for r in found.collect()} == {("a", None), ("b", 1)}
    assert "PartitionFilters: [isnotnull(method" in plan(found.filter("method = 'b'"))


def test_methods_of_own_paths(spark, tmp_path):
    paths = {m: str(tmp_path / m) for m in ("a", "b")}
    spark.createDataFrame([("k", 1.0)], "request_id string, q50 double").write.parquet(paths["a"])
    spark.createDataFrame([("k", 2.0, 3)], "request_id string, q50 double, more int").write.parquet(paths["b"])
    found = cache.all_methods(spark, paths)
    assert {(r.method, r.q50, r.more) for r in found.collect()} == {("a", 1.0, None), ("b", 2.0, 3)}
