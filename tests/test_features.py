"""Features, subsets of request rows, stored results and whole searches on small own cases."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellwerk.operators import features, metrics, requests
from stellwerk.plans import queries, relations
from stellwerk.sources import cache, stops

ROW = "request_id string, run_id string, stop_num int, train_type string, station string, train_key string, line_number string, weekday int, run_planned_min int, n_stops int, stop_frac double, arr_hour int, arr_minute int, arr_delay int, arr_canceled boolean"


def row(request, run, station, line, delay=3, canceled=False):
    return (request, run, 2, "RE", station, f"RE {run}", line, 1, None, 4, 0.5, 7, 30, delay, canceled)


def test_codes_are_shared_within_a_request(spark):
    past = spark.createDataFrame([row("a", "r1", "Ulm", "7"), row("a", "r2", "Aue", None), row("b", "r3", "Ulm", "9")], ROW)
    asked = spark.createDataFrame([row("a", "r4", "Köln", "10", None), row("b", "r5", None, None, None)], ROW)
    found = {r.run_id: r for r in features.coded(past, asked, "arr").collect()}
    assert {k: (r.station, r.line_number, r.train_key, r.asked, r.target) for k, r in found.items()} == {
        "r1": (2, 1, 0, False, 3), "r2": (0, None, 1, False, 3), "r4": (1, 0, 2, True, None), "r3": (0, 0, 0, False, 3), "r5": (None, None, 1, True, None)
    }
    assert found["r1"].asDict().keys() == {"request_id", "run_id", "stop_num", "asked", "target", *features.feature_columns("arr")}
    assert features.coded(past.limit(0), asked.limit(0), "arr").count() == 0


def test_usable_and_event_columns(spark):
    rows = spark.createDataFrame([row("a", "r1", "Ulm", "7"), row("a", "r2", "Ulm", "7", None), row("a", "r3", "Ulm", "7", 1, True)], ROW)
    assert [r.run_id for r in features.usable_rows(rows, "arr").collect()] == ["r1"]
    assert {"hour", "minute", "delay", "canceled"} < set(features.of_event(rows, "arr").columns)
    assert not {"arr_hour", "hour"} & set(features.of_event(rows, "dep").columns)


def test_subsets(spark):
    rows = [(q, m, t, datetime(2031, 3, d, 9)) for q, d in (("q3", 1), ("q1", 2), ("q2", 2)) for m in ("arr", "dep") for t in ("RE", "S")]
    frame = spark.createDataFrame(rows, "request_id string, model string, train_type string, now timestamp_ntz")
    ids = lambda **how: sorted(r.request_id for r in requests.subset(frame, **how).collect())
    assert ids() == sorted(r[0] for r in rows) and ids(first=1) == ["q1"] * 4 and ids(first=9) == ids()
    assert ids(day="2031-03-01", models=("arr",)) == ["q3"] * 2 and ids(first=1, day="2031-03-01", train_type="S", models=("dep",)) == ["q3"]


def test_stored_results_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, None)], "request_id string, stop_num int, delay int")
    path = str(tmp_path / "done")
    cache.add(spark.createDataFrame([("a", 2, 1.5, 9), ("c", 1, 2.5, 9)], "request_id string, stop_num int, q50 double, delay int"), path)
    found = cache.with_results(rows, spark.read.parquet(path), "request_id", "stop_num")
    assert {(r.request_id, r.stop_num): (r.delay, r.q50) for r in found.collect()} == {("a", 1): (5, None), ("a", 2): (6, 1.5), ("b", 1): (None, None)}
    assert [r.request_id for r in cache.pending(rows, path, "request_id").collect()] == ["b"] and stops.raw_rows(spark, path) == 2


def test_summary(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("x", 5), ("x", None), ("y", None)], "g string, v int")
    found = {r.g: r for r in metrics.summary(rows, "v", "g").collect()}
    assert tuple(found["x"])[1:] == (3, round(8 / 3, 9), round((13 / 3) ** 0.5, 9), 1, 1.5, 2.0, 3.5, 5) and found["y"].n == 0 and found["y"].mean is None


def test_ranked_routes_of_drawn_requests(spark):
    """Every drawn route is ranked once, in the order of its planned arrival."""
    rows = relations.stops(spark, "/root/testdata/sf0.001")
    legs = queries.journeys(rows).collect()
    ends = {}
    for leg in legs:
        ends[leg.request_id, leg.route] = max(ends.get((leg.request_id, leg.route), leg.arr), leg.arr)
    found = queries.drawn_routes_ranked(rows).collect()
    assert len(found) == len(ends) and {(r.request_id, r.route): r.planned_arrival for r in found} == ends
    by_rank = sorted(found, key=lambda r: (r.request_id, r["rank"]))
    assert all(a.planned_arrival <= b.planned_arrival for a, b in zip(by_rank, by_rank[1:], strict=False) if a.request_id == b.request_id)


def test_bootstrap_interval(spark):
    """The interval of many keys, in few and in many buckets, is that of draws with replacement."""
    rng = np.random.default_rng(5)
    rows = [(f"k{k}", float(x), 0.0) for k, x in enumerate(rng.gamma(2.0, 3.0, 300)) for _ in range(1 + k % 3)]
    losses = spark.createDataFrame(rows, "request_id string, new double, old double")
    n = np.array([1 + k % 3 for k in range(300)])
    d = np.array([next(r[1] for r in rows if r[0] == f"k{k}") for k in range(300)]) * n
    drawn = rng.integers(0, 300, (4000, 300))
    low, high = np.percentile(d[drawn].sum(1) / n[drawn].sum(1), [2.5, 97.5])
    for bucket_keys in (1_000, 20):
        (found,) = metrics.bootstrap_difference(losses, "new", "old", bucket_keys=bucket_keys).collect()
        assert found.keys == 300 and abs(found.difference - d.sum() / n.sum()) < 1e-9
        assert abs(found.low - low) < 0.1 and abs(found.high - high) < 0.1 and found.low < found.difference < found.high
        assert tuple(metrics.bootstrap_difference(losses.repartition(5), "new", "old", bucket_keys=bucket_keys).first()) == pytest.approx(tuple(found), abs=1e-9)
    assert metrics.bootstrap_difference(losses.limit(0), "new", "old").first().keys == 0


def test_draws_have_as_many_keys_as_there_are(spark):
    """Every draw's counts, over all buckets, make the number of keys, and are spread as draws with replacement are."""
    keys = spark.range(500).select(F.col("id").alias("key"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("bucket"))
    sizes = {r.bucket: r["count"] for r in keys.groupBy("bucket").count().collect()}
    splits = {r.s_bucket: np.array([(x.n, x.lower) for x in r.splits]) for r in metrics._splits(keys, 4).collect()}
    assert set(sizes) == set(splits) and all(len(s) == 4 and s[0][0] == 500 for s in splits.values())
    times = np.concatenate([metrics.resampled(splits[b], 500, sizes[b], b, 3_000, 7) for b in sizes], axis=1)
    assert times.shape == (3_000, 500) and (times.sum(1) == 500).all()
    assert abs(times.mean() - 1) < 1e-9 and abs(times.var() - (1 - 1 / 500)) < 0.01 and abs((times == 0).mean() - (1 - 1 / 500) ** 500) < 0.002
    assert abs(np.cov(times[:, 0], times[:, 499])[0, 1] + 1 / 500) < 0.08


def test_shared_keys(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("c", "y"), ("c", "x"), ("c", "other"), (None, "x"), ("d", None)], "request_id string, method string")
    assert {(r.request_id, r.n) for r in metrics.shared_keys(rows, ["x", "y"]).collect()} == {("a", 3), ("c", 3)}
    assert {(r.request_id, r.has) for r in metrics.methods_of(rows, ["x", "y"]).collect()} == {("a", 3), ("b", 1), ("c", 3), (None, 1), ("d", 0)}
