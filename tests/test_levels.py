"""Quantiles that hang on a stop: equal to those of each level on its own, with one shuffle of stops for the finest level."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stellwerk.operators import baselines, routing, visibility
from stellwerk.plans import queries, relations
from stellwerk.sources.stops import with_features
from test_days import BASE

SF = "/root/testdata/sf0.001"


def odd_stops(spark):
    """Two trains and rows without a train, several runs a day, with canceled events and runs that end days later."""
    dice, rows = random.Random(5), []
    for day in range(40):
        start = datetime(2031, 3, 1) + timedelta(days=day)
        for n, key in enumerate(("RE 1", "RE 1", "RE 2", None)):
            for stop in range(1, 4):
                at = start + timedelta(hours=dice.choice((5, 6, 23, 47)), minutes=dice.randrange(60))
                lost = [dice.random() < 0.2 for _ in range(2)]
                late = [None if dice.random() < 0.1 else dice.randrange(-3, 90) for _ in range(2)]
                rows.append((f"{n}@{day}", start if day % 9 else None, "RE", key, None, None, dice.choice(("A", "B", None)), stop, at if stop > 1 else None, at if stop < 3 else None, *lost, *late))
    return with_features(spark.createDataFrame(rows, BASE), "2031-03-20", "2031-04-01")


def test_levels_of_stops(spark):
    stops = relations.kept(odd_stops(spark))
    columns = ("run_id", "stop_num", "arr_delay")
    asked = stops.filter("stop_num = 2 and run_day > '2031-03-12'")
    expected, finest = {}, 0
    for m in ("arr", "dep"):
        for r in baselines.level_quantiles(stops, stops, m).collect():
            usual = next((x for x in (r.level0, r.level1, r.level2) if x is not None), None)
            finest += r.level0 is not None and r.level0 != r.level1
            expected.setdefault((r.run_id, r.stop_num), []).extend((usual, r.level2))
    found = {(r.run_id, r.stop_num): [r.arr_usual, r.arr_overall, r.dep_usual, r.dep_overall] for r in baselines.stop_levels(stops, columns).collect()}
    assert found == expected and len(found) == stops.count() and finest > 20
    part = {(r.run_id, r.stop_num): [r.arr_usual, r.arr_overall, r.dep_usual, r.dep_overall] for r in baselines.stop_levels(stops, columns, asked).collect()}
    assert part == {k: expected[k] for k in part} and len(part) == asked.count() > 50


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]


def test_stops_meet_their_levels_once(spark):
    """Quantiles are added to stops that are with their run already, and the finest level takes one shuffle for both events."""
    stops = relations.stops(spark, SF)
    for query in (queries.score_grouping_sets(stops), queries.scores_by_group(stops)):
        assert len([x for x in exchanges(query) if "train_key#" in x]) == 1
    found = exchanges(baselines.stop_levels(stops, relations.ASKED))
    assert len([x for x in found if "train_key#" in x]) == 1 and len([x for x in found if "run_id#" in x]) == 1


def below_exchange(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return plan[next(k for k, x in enumerate(plan) if f"Exchange hashpartitioning({key}" in x) + 1]


def test_ends_are_shuffled_flat(spark):
    """Both ends of a connection go to their station as plain columns, and are read of the connections in one pass."""
    conns = relations.kept(visibility.connections(relations.stops(spark, SF)))
    found = routing.next_departures(conns)
    assert "struct(" not in below_exchange(found, "at#") and found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.filter(F.col("t.t_station") != F.col("next_station")).count() == 0 < found.count()


def test_events_are_shuffled_as_numbers(spark):
    line = below_exchange(relations.from_events(spark, SF), "concat(")
    assert line.strip().startswith("+- Project [event_id#") and "run_id" not in line and "concat(" not in line
