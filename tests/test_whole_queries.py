"""Registered queries cover every day and row that their operators can take."""

from pyspark.sql import functions as F

from stellwerk.operators import visibility
from stellwerk.plans import queries, relations


def stops_of(spark, sf):
    return relations.stops(spark, f"/root/testdata/{sf}")


def test_training_rows_keep_all_below_the_cap(spark):
    """More than 2,000 rows of one type, far fewer than ROWS_PER_TYPE."""
    stops = stops_of(spark, "sf0.01").withColumn("train_type", F.lit("RE"))
    usable = {(r.run_id, r.stop_num) for r in stops.collect() if r.arr_delay is not None and not r.arr_canceled}
    found = [(r.run_id, r.stop_num) for r in queries.capped_training_rows(stops).collect()]
    assert len(usable) > 2_000 and len(found) == len(usable) and set(found) == usable


def test_requests_of_every_day(spark):
    """Every arrival is asked for, and a request's context is all it may hold, more than 200 rows."""
    stops = stops_of(spark, "sf0.001")
    arrivals = {(r.run_id, r.stop_num): r for r in stops.collect() if r.planned_arr is not None}
    predicted = queries.predict_arrivals(stops).collect()
    assert len(predicted) == len(arrivals) and {(r.run_id, r.stop_num) for r in predicted} == set(arrivals)
    for r in predicted:
        own = arrivals[r.run_id, r.stop_num]
        assert r.request_id == f"{own.run_day:%Y-%m-%d}-{own.train_type}-{own.planned_arr.hour // 4}"


def test_contexts_are_not_cut(spark):
    stops = stops_of(spark, "sf0.01").filter("run_day < '2024-01-09'")
    sizes = {r.request_id: r["count"] for r in queries.context_rows(stops).groupBy("request_id").count().collect()}
    assert {k[:10] for k in sizes} == {f"2024-01-{d:02d}" for d in range(1, 9)}
    assert max(sizes.values()) > 200


def test_weights_of_the_sample(spark):
    stops = stops_of(spark, "sf0.001")
    runs = {r.run_id: r for r in queries.sampling.week_runs(stops).withColumn("h", queries.sampling.hash_order(0, "run_id")).collect()}
    total, found = sum(r.n_rows for r in runs.values()), {r.group: r for r in queries.group_weights(stops).collect()}
    assert set(found) == {r.group for r in runs.values()}
    for group, r in found.items():
        own = sorted((x for x in runs.values() if x.group == group), key=lambda x: (x.h, x.run_id))
        n_all, n_drawn = sum(x.n_rows for x in own), sum(x.n_rows for x in own[:60])
        assert (r.n_all, r.n_drawn) == (n_all, n_drawn) and abs(r.weight - n_all / total / n_drawn) < 1e-9


def test_legs_of_every_day(spark):
    stops = stops_of(spark, "sf0.001")
    days = {f"{r.run_day:%Y-%m-%d}" for r in visibility.connections(stops).collect()}
    found = queries.two_leg_journeys(stops)
    assert {r.request_id[-10:] for r in found.select("request_id").collect()} == days and len(days) == 30


def test_earliest_arrivals_of_every_day(spark):
    found = {r.request_id for r in queries.earliest_arrivals(stops_of(spark, "sf0.001")).collect()}
    assert len({x[:10] for x in found}) == 30 and len({x[11:] for x in found}) > 5


def test_stations_of_the_context_split(spark):
    """The busiest station of the tested days is not among those that requests are drawn from."""
    stops = stops_of(spark, "sf0.001")
    later = stops.filter("split <> 'context'").withColumn("station", F.lit("new"))
    found = queries.sampling.busy_stations(stops.filter("split = 'context'").unionByName(later), 300)
    assert later.filter("planned_dep is not null").count() > found.agg(F.max("departures")).first()[0] and found.filter("station = 'new'").count() == 0
    asked = queries.requests.drawn_requests(stops.filter("split = 'context'").unionByName(later))
    assert asked.count() > 0 and asked.filter("src = 'new' or dst = 'new'").count() == 0


def test_busy_stations_of_every_day(spark):
    stops = stops_of(spark, "sf0.001")
    later = stops.filter("split <> 'context'").withColumn("station", F.lit("new"))
    found = queries.busy_stations(stops.filter("split = 'context'").unionByName(later))
    assert found.first().station == "new" and found.first().departures == later.filter("planned_dep is not null").count()


def test_no_twins():
    assert not [name for name in queries.QUERIES if name.endswith("_every_day")]


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]


def test_rows_meet_their_run_once(spark):
    """Legs are shuffled by run only, and predictions and losses of their rows need no shuffle after it."""
    from stellwerk.plans import relations

    stops = stops_of(spark, "sf0.001")
    legs = relations.legs(stops)
    found = exchanges(relations.request_rows(stops, relations.kept(relations.requests(legs)), legs))
    assert len(found) == 2 and all("(run_id#" in x or "(l_run#" in x for x in found)
    scored = exchanges(queries._scored(stops))
    assert not [x for x in scored if "request_id" in x]
    assert len(exchanges(queries.metrics.loss_pivot(queries._scored(stops), ["global", "train_station"], "request_id", "run_id", "stop_num", "model"))) == len(scored)


def test_legs_meet_predictions_once(spark):
    from stellwerk.plans import relations

    stops = stops_of(spark, "sf0.001")
    legs = relations.legs(stops)
    found = exchanges(relations.leg_sides(stops, relations.kept(relations.requests(legs)), legs))
    assert len(found) == 2 and all("(run_id#" in x for x in found)


def test_stops_are_shuffled_once(spark):
    assert len(exchanges(queries.r.from_events(spark, "/root/testdata/sf0.001"))) == 1


def test_train_history_deals_rows_after_its_shuffle(spark):
    plan = queries.same_train_history(stops_of(spark, "sf0.001"))._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [k for k, x in enumerate(plan) if "Generate explode" in x]
    assert at and not [x for x in plan[: at[0]] if "Exchange" in x] and [x for x in plan[at[0] :] if "Exchange hashpartitioning(train_key" in x]
    assert not [x for x in plan if "Broadcast" in x]
