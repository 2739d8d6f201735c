"""The entry query, SQL twins of the registered queries, and the baseline's history rule."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from stellwerk.operators.baselines import global_quantiles
from stellwerk.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHECKED = ["stops_derived", "stop_features", "connections", "known_at", "last_known_arr", "last_seen", "baseline_train_station", "two_leg_journeys", "replayed_transfers", "slots_join", "same_train_history", "busy_stations", "stratified_runs", "group_weights", "earliest_arrivals", "drawn_requests", "all_stations", "coded_features", "legs_per_route"]


def text(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    a = sorted([text(r[c]) for c in columns] for r in found.collect())
    b = sorted([text(r[want.columns.index(c)]) for c in columns] for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_history_leaves_out_the_query_day(spark):
    day, before = datetime(2026, 9, 20), datetime(2026, 9, 19)
    rows = [(f"r{k}", before, datetime(2026, 9, 19, 12), 1) for k in range(10)] + [("late", before, datetime(2026, 9, 20, 0, 30), 99)]
    schema = "run_id string, run_day timestamp_ntz, planned_arr timestamp_ntz, arr_delay int"
    more = "*, cast(null as timestamp_ntz) planned_dep, cast(null as int) dep_delay, 'S' station, 'RE 1' train_key, 12.0D arr_hour, false arr_canceled"
    stops = spark.createDataFrame(rows, schema).selectExpr(*more.split(", "))
    query = spark.createDataFrame([("q", day, day, None)], schema).selectExpr(*more.split(", "))
    (found,) = global_quantiles(stops, query, "arr").collect()
    assert found.q95 == 1.0
