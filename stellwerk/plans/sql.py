"""The queries in DuckDB SQL. Common table expressions follow the relations of the queries."""

from __future__ import annotations

from stellwerk.functions.risk import LONG_DISTANCE

STOPS = r"""
    raw AS (SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS d, date_trunc('minute', ts) AS m, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
    num AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS stop_num, count(*) OVER (PARTITION BY user_id, d) AS last FROM raw),
    can AS (SELECT *, stop_num > 1 AND event_type = 'error' AND k % 5 = 0 AS arr_canceled, stop_num < last AND event_type = 'error' AND k % 7 = 0 AS dep_canceled,
                   ['ICE', 'RE', 'RB', 'S', 'NJ'][CAST(user_id % 5 + 1 AS INT)] AS train_type FROM num),
    base AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS run_id, CAST(d AS TIMESTAMP) AS run_day, train_type, train_type || ' ' || CAST(user_id AS VARCHAR) AS train_key,
                    'ST' || CAST(CAST(floor(sqrt(k)) AS INT) AS VARCHAR) AS station, CAST(stop_num AS INT) AS stop_num,
                    CASE WHEN stop_num > 1 THEN m END AS planned_arr, CASE WHEN stop_num < last THEN m + INTERVAL 2 MINUTE END AS planned_dep, arr_canceled, dep_canceled,
                    CASE WHEN stop_num > 1 AND NOT arr_canceled THEN CAST(floor(value / 10) - 1 AS INT) END AS arr_delay,
                    CASE WHEN stop_num < last AND NOT dep_canceled THEN CAST(floor(value / 10) - 1 AS INT) + k % 3 END AS dep_delay FROM can),
    lagged AS (SELECT *, lag(stop_num) OVER w AS p_num, lag(station) OVER w AS p_station, lag(planned_dep) OVER w AS p_dep, max(stop_num) OVER (PARTITION BY run_id) AS n_stops
               FROM base WINDOW w AS (PARTITION BY run_id ORDER BY stop_num)),
    stops AS MATERIALIZED (SELECT run_id, run_day, train_type, train_key, station, stop_num, planned_arr, planned_dep, arr_canceled, dep_canceled, arr_delay, dep_delay, n_stops,
                     CASE WHEN run_day < '2024-01-17' THEN 'context' WHEN run_day < '2024-01-24' THEN 'validation' ELSE 'test' END AS split,
                     CASE WHEN stop_num - p_num = 1 THEN p_station END AS prev_station,
                     CASE WHEN stop_num - p_num = 1 AND abs(date_sub('minute', p_dep, planned_arr)) <= 1200 THEN date_sub('minute', p_dep, planned_arr) END AS run_planned_min,
                     date_sub('minute', planned_arr, planned_dep) AS dwell_planned_min, stop_num / n_stops AS stop_frac,
                     hour(planned_arr) AS arr_hour, minute(planned_arr) AS arr_minute, hour(planned_dep) AS dep_hour, minute(planned_dep) AS dep_minute,
                     isodow(coalesce(planned_dep, planned_arr)) AS weekday,
                     planned_arr + to_minutes(arr_delay) AS act_arr, planned_dep + to_minutes(dep_delay) AS act_dep FROM lagged)"""

CONNS = r"""
    ahead AS (SELECT *, lead(station) OVER w AS next_station, lead(stop_num) OVER w AS next_stop_num, lead(planned_arr) OVER w AS arr, lead(act_arr) OVER w AS arr_actual, lead(arr_canceled) OVER w AS next_canceled
              FROM stops WINDOW w AS (PARTITION BY run_id ORDER BY stop_num)),
    conns AS MATERIALIZED (SELECT run_id, run_day, station, stop_num, next_station, next_stop_num, planned_dep AS dep, act_dep AS dep_actual, dep_canceled, arr, arr_actual, next_canceled AS arr_canceled
              FROM ahead WHERE planned_dep IS NOT NULL AND arr IS NOT NULL AND arr >= planned_dep)"""

LEGS = r"""
    late AS (SELECT * FROM conns),
    pairs AS (SELECT a.*, min((b.dep, b.arr, b.run_id, b.stop_num, b.station, b.next_station, b.next_stop_num)) AS t
              FROM late a JOIN late b ON a.next_station = b.station AND a.run_day = b.run_day AND a.run_id <> b.run_id AND b.dep >= a.arr + INTERVAL 5 MINUTE GROUP BY ALL),
    found AS (SELECT station || '>' || next_station || '>' || CAST(CAST(run_day AS DATE) AS VARCHAR) AS request_id, station AS src, next_station AS dst, dep, run_id, stop_num, 1 AS n, next_station, next_stop_num, arr, NULL AS t FROM late
              UNION ALL SELECT station || '>' || t[6] || '>' || CAST(CAST(run_day AS DATE) AS VARCHAR), station, t[6], dep, run_id, stop_num, 2, next_station, next_stop_num, arr, t FROM pairs),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY dep, n, run_id, stop_num) - 1 AS route FROM found WHERE src <> dst),
    legs AS MATERIALIZED (SELECT request_id, route, CAST(0 AS BIGINT) AS leg, run_id, src AS from_station, stop_num AS from_stop_num, dep, next_station AS to_station, next_stop_num AS to_stop_num, arr FROM numbered
             UNION ALL SELECT request_id, route, 1, t[3], t[5], t[4], t[1], t[6], t[7], t[2] FROM numbered WHERE n = 2)"""

LOG = r"""
    idx AS (SELECT *, CASE WHEN coalesce(planned_arr, planned_dep) IS NOT NULL THEN row_number() OVER (PARTITION BY run_id ORDER BY coalesce(planned_arr, planned_dep) NULLS LAST, stop_num) END AS i FROM stops),
    log AS MATERIALIZED (SELECT run_id, i, true AS is_arr, act_arr AS time, planned_arr AS planned, arr_delay AS delay FROM idx WHERE act_arr IS NOT NULL
            UNION ALL SELECT run_id, i, false, act_dep, planned_dep, dep_delay FROM idx WHERE act_dep IS NOT NULL)"""

_LONG = ", ".join(f"'{t}'" for t in LONG_DISTANCE)
GROUP = f"CASE WHEN train_type IN ({_LONG}) THEN 'long-distance' WHEN train_type IN ('S', 'RE', 'RB') THEN train_type ELSE 'other' END"

ROWS = rf"""
    keys AS (SELECT DISTINCT request_id, run_id, from_stop_num AS stop_num, 'dep' AS model FROM legs UNION SELECT DISTINCT request_id, run_id, to_stop_num, 'arr' FROM legs),
    asked AS (SELECT request_id, min(dep) AS now FROM legs GROUP BY request_id),
    seen AS (SELECT k.request_id, k.run_id, arg_max(delay, (time, i, NOT is_arr)) AS seen_delay
             FROM (SELECT DISTINCT request_id, run_id FROM keys) k JOIN asked USING (request_id) JOIN log ON log.run_id = k.run_id AND log.time < asked.now GROUP BY ALL),
    rws AS MATERIALIZED (SELECT k.request_id, k.model, asked.now, s.*, CASE k.model WHEN 'dep' THEN dep_delay ELSE arr_delay END AS delay,
                   date_sub('minute', asked.now, CASE k.model WHEN 'dep' THEN planned_dep ELSE planned_arr END) AS minutes_ahead, seen.seen_delay, {GROUP} AS grp
            FROM keys k JOIN asked USING (request_id) JOIN stops s ON s.run_id = k.run_id AND s.stop_num = k.stop_num
            LEFT JOIN seen ON seen.request_id = k.request_id AND seen.run_id = k.run_id),
    rw AS MATERIALIZED (SELECT *, CASE WHEN seen_delay IS NULL THEN 'not seen' WHEN minutes_ahead <= 15 THEN 'seen, up to 15 min' WHEN minutes_ahead <= 60 THEN 'seen, 15 to 60 min' ELSE 'seen, over 60 min' END AS cas FROM rws)"""


def _history(e: str, rows: str, name: str) -> str:
    """CTEs name_0..2 (quantile lists by level) and name (rows with q50, q80, q95) for event e and the relation rows."""
    q = f"quantile_cont(CAST({e}_delay AS DOUBLE), [0.5, 0.8, 0.95])"
    return rf"""
    {name}_days AS (SELECT DISTINCT run_day AS day FROM {rows}),
    {name}_hist AS MATERIALIZED (SELECT day, s.* FROM {name}_days JOIN stops s ON s.run_day < day AND s.run_day >= day - INTERVAL 14 DAY
                    WHERE {e}_delay IS NOT NULL AND NOT {e}_canceled AND greatest(planned_arr, planned_dep, act_arr, act_dep) < day),
    {name}_0 AS (SELECT day, train_key, station, {q} AS q FROM {name}_hist GROUP BY ALL HAVING count(*) >= 10),
    {name}_1 AS (SELECT day, station, {e}_hour AS h, {q} AS q FROM {name}_hist GROUP BY ALL HAVING count(*) >= 10),
    {name}_2 AS (SELECT day, {q} AS q FROM {name}_hist GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT r.*, CASE WHEN r.{e}_hour IS NOT NULL THEN coalesce(a.q, b.q, c.q) END AS usual, CASE WHEN r.{e}_hour IS NOT NULL THEN c.q END AS overall
               FROM {rows} r LEFT JOIN {name}_0 a ON a.day = r.run_day AND a.train_key = r.train_key AND a.station = r.station
               LEFT JOIN {name}_1 b ON b.day = r.run_day AND b.station = r.station AND b.h = r.{e}_hour LEFT JOIN {name}_2 c ON c.day = r.run_day)"""


PREDICTED = (
    r"""
    rw_arr AS (SELECT * FROM rw WHERE model = 'arr'), rw_dep AS (SELECT * FROM rw WHERE model = 'dep'),"""
    + _history("arr", "rw_arr", "pa")
    + ","
    + _history("dep", "rw_dep", "pd")
    + r""",
    events_pred AS (SELECT * FROM pa UNION ALL SELECT * FROM pd),
    pred AS MATERIALIZED (SELECT *, 'global' AS method, overall AS q FROM events_pred UNION ALL SELECT *, 'train_station', usual FROM events_pred
             UNION ALL SELECT *, 'carry_forward', CASE WHEN seen_delay IS NOT NULL AND usual IS NOT NULL THEN [seen_delay + (usual[1] - usual[1]), seen_delay + (usual[2] - usual[1]), seen_delay + (usual[3] - usual[1])] ELSE usual END FROM events_pred)"""
)
SCORED = r"""
    scored AS (SELECT *, greatest(0.5 * (delay - q[1]), -0.5 * (delay - q[1])) AS l50, greatest(0.8 * (delay - q[2]), (0.8 - 1) * (delay - q[2])) AS l80,
                      greatest(0.95 * (delay - q[3]), (0.95 - 1) * (delay - q[3])) AS l95 FROM pred WHERE delay IS NOT NULL AND q IS NOT NULL)"""
SCORES = r"""count(*) AS n, round(avg(l50), 9) AS pinball_q50, round(avg(l80), 9) AS pinball_q80, round(avg(l95), 9) AS pinball_q95, round(avg((l50 + l80 + l95) / 3), 9) AS pinball,
    round(avg(abs(delay - q[1])), 9) AS mae, round(avg(CAST(delay <= q[1] AS INT)), 9) AS coverage_q50, round(avg(CAST(delay <= q[2] AS INT)), 9) AS coverage_q80, round(avg(CAST(delay <= q[3] AS INT)), 9) AS coverage_q95"""

TRANSFERS = r"""
    chg AS (SELECT m.method, a.request_id, a.route, a.leg, a.run_id, a.to_stop_num, b.run_id AS next_run, b.from_stop_num AS next_stop, date_sub('minute', a.arr, b.dep) - 2 AS room, pa1.q AS q, pb.q AS dq
            FROM (VALUES ('global'), ('train_station')) m(method), legs a JOIN legs b ON a.request_id = b.request_id AND a.route = b.route AND b.leg = a.leg + 1
            LEFT JOIN pred pa1 ON pa1.method = m.method AND pa1.model = 'arr' AND pa1.request_id = a.request_id AND pa1.run_id = a.run_id AND pa1.stop_num = a.to_stop_num
            LEFT JOIN pred pb ON pb.method = 'carry_forward' AND pb.model = 'dep' AND pb.request_id = b.request_id AND pb.run_id = b.run_id AND pb.stop_num = b.from_stop_num),
    wt AS (SELECT *, room + greatest(coalesce(dq[1], 0), 0) AS wait, greatest(q[2], q[1] + 0.5) AS q80, greatest(q[3], greatest(q[2], q[1] + 0.5) + 0.5) AS q95 FROM chg),
    pr AS (SELECT *, CASE WHEN q IS NULL THEN NULL WHEN wait < q[1] THEN 0.5 * exp((wait - q[1]) * ln(2.5) / (q80 - q[1])) WHEN wait < q80 THEN 0.5 + 0.3 * (wait - q[1]) / (q80 - q[1])
                     WHEN wait < q95 THEN 0.8 + 0.15 * (wait - q80) / (q95 - q80) ELSE 1 - 0.05 * exp(-(wait - q95) * ln(4) / (q95 - q80)) END AS p FROM wt),
    tr AS MATERIALIZED (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN p >= 0.97 THEN 1 WHEN p >= 0.8 THEN 2 WHEN p >= 0.5 THEN 3 ELSE 4 END AS level FROM pr)"""

OUTCOME = r"""
    oc AS (SELECT tr.*, coalesce(i.arr_canceled, false) OR coalesce(o.dep_canceled, false) AS canceled,
                  CASE WHEN coalesce(i.arr_canceled, false) OR coalesce(o.dep_canceled, false) THEN false ELSE date_sub('minute', i.act_arr, o.act_dep) >= 2 END AS held
           FROM tr LEFT JOIN stops i ON i.run_id = tr.run_id AND i.stop_num = tr.to_stop_num LEFT JOIN stops o ON o.run_id = tr.next_run AND o.stop_num = tr.next_stop),
    ok AS (SELECT * FROM oc WHERE held IS NOT NULL AND NOT canceled AND p IS NOT NULL)"""

CUT = {
    "last_known_arr": ("arr", "i2.i > log.i", "least(TIMESTAMP '2024-01-20 14:00', date_trunc('day', s.planned_arr) + INTERVAL 840 MINUTE, s.act_arr)"),
    "last_known_dep": ("dep", "(i2.i > log.i OR (i2.i = log.i AND log.is_arr))", "least(TIMESTAMP '2024-01-20 14:00', date_trunc('day', s.planned_dep) + INTERVAL 840 MINUTE, s.act_dep)"),
    "last_known_now": ("arr", "i2.i > log.i", "TIMESTAMP '2024-01-20 14:00'"),
}


def _last_known(e: str, earlier: str, cut: str, name: str = "lk", where: str = "true") -> str:
    return rf"""
    {name}_t AS (SELECT s.*, i2.i AS own, {cut} AS cut FROM stops s JOIN idx i2 ON i2.run_id = s.run_id AND i2.stop_num = s.stop_num WHERE s.planned_{e} IS NOT NULL AND {where}),
    {name}_f AS (SELECT i2.run_id, i2.stop_num, arg_max((log.delay, log.planned, log.i), (log.time, log.i, NOT log.is_arr)) AS e
             FROM (SELECT run_id, stop_num, own AS i, cut FROM {name}_t) i2 JOIN log ON log.run_id = i2.run_id AND log.time < i2.cut AND {earlier} GROUP BY ALL),
    {name} AS (SELECT t.*, CAST(f.e[1] AS BIGINT) AS last_known_delay, date_sub('minute', f.e[2], t.planned_{e}) AS minutes_since_known, CAST(t.own - f.e[3] AS BIGINT) AS stops_since_known
           FROM {name}_t t LEFT JOIN {name}_f f ON f.run_id = t.run_id AND f.stop_num = t.stop_num)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + " "


KNOWN = r"""
    known AS (SELECT * REPLACE (CASE WHEN act_arr < now THEN arr_delay END AS arr_delay, CASE WHEN act_dep < now THEN dep_delay END AS dep_delay)
              FROM (SELECT *, TIMESTAMP '{now}' AS now FROM stops) WHERE run_day < now AND (act_arr < now OR act_dep < now))"""
QUERY = "    qry AS (SELECT * FROM stops WHERE planned_arr IS NOT NULL)"
Q6 = "round({q}[1], 6) AS q50, round({q}[2], 6) AS q80, round({q}[3], 6) AS q95"
ALL_LEGS = (STOPS, CONNS, LEGS)
ALL_PRED = (*ALL_LEGS, LOG, ROWS, PREDICTED)

DRAWN_RUNS = rf"""
    runs AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(run_id || ':0'), run_id) AS nth FROM (SELECT run_id, {GROUP} AS grp, count(*) AS n_rows FROM stops GROUP BY 1, 2))"""


def _round(k: int) -> str:
    """One more boarding: the runs that can be reached, ridden on from there, and the best of before and now."""
    return rf"""
    on{k} AS (SELECT request_id, b.run_day, run_id, min(dep) AS since FROM best{k - 1} b JOIN conns c ON c.station = b.place AND c.run_day = b.run_day
              AND c.dep >= b.ready + CASE WHEN b.source THEN INTERVAL 0 MINUTE ELSE INTERVAL 5 MINUTE END GROUP BY ALL),
    best{k} AS MATERIALIZED (SELECT request_id, run_day, place, min(ready) AS ready, arg_min(source, (ready, NOT source)) AS source
              FROM (SELECT * FROM best{k - 1} UNION ALL SELECT request_id, o.run_day, next_station, arr, false FROM on{k} o JOIN conns c ON c.run_id = o.run_id AND c.dep >= o.since) GROUP BY ALL)"""


REACH = (
    r"""
    best0 AS (SELECT CAST(CAST(run_day AS DATE) AS VARCHAR) || '-' || station AS request_id, run_day, station AS place, min(planned_dep) AS ready, true AS source FROM stops WHERE planned_dep IS NOT NULL GROUP BY run_day, station),"""
    + ",".join(_round(k) for k in (1, 2, 3))
)

ORACLE_SQL = {
    "stops_derived": _with(STOPS) + "SELECT run_id, run_day, train_type, train_key, station, stop_num, planned_arr, planned_dep, arr_canceled, dep_canceled, arr_delay, dep_delay FROM stops",
    "stop_features": _with(STOPS)
    + """SELECT run_id, split, prev_station, stop_num, n_stops, CAST(dwell_planned_min AS INT) AS dwell_planned_min, CAST(run_planned_min AS INT) AS run_planned_min, CAST(weekday AS INT) AS weekday,
        round(stop_frac, 6) AS stop_frac, CAST(arr_hour AS DOUBLE) AS arr_hour, CAST(arr_minute AS DOUBLE) AS arr_minute, CAST(dep_hour AS DOUBLE) AS dep_hour, CAST(dep_minute AS DOUBLE) AS dep_minute FROM stops""",
    "repeated_keys": _with(STOPS)
    + "SELECT run_day, split, count(*) AS n_rows, count(DISTINCT run_id) AS runs, (SELECT count(*) FROM (SELECT 1 FROM stops GROUP BY run_id, stop_num HAVING count(*) > 1)) AS repeated FROM stops GROUP BY run_day, split",
    "destination_spelling": _with(
        STOPS,
        """ rawd AS (SELECT run_id, stop_num, station, CASE WHEN station <> 'ST3' THEN lower(station) END AS xml,
              CASE WHEN stop_num % 3 = 0 THEN NULL WHEN stop_num % 3 = 1 THEN lower(prev_station) ELSE 'bus ' || station END AS dest FROM stops),
            names AS (SELECT xml, min(station) AS translated FROM (SELECT DISTINCT xml, station FROM rawd) GROUP BY xml HAVING count(*) = 1)""",
    )
    + "SELECT run_id, stop_num, coalesce(translated, dest, station) AS final_destination FROM rawd LEFT JOIN names ON names.xml IS NOT DISTINCT FROM rawd.dest",
    "connections": _with(STOPS, CONNS) + "SELECT run_id, station, stop_num, next_station, next_stop_num, dep, dep_actual, dep_canceled, arr, arr_actual, arr_canceled FROM conns",
    "timetable_day": _with(
        STOPS.replace("stops AS MATERIALIZED (", "all_stops AS MATERIALIZED (")
        + """, stops AS (SELECT * FROM all_stops WHERE run_day BETWEEN '2024-01-19' AND '2024-01-21' AND coalesce(planned_dep, planned_arr) BETWEEN '2024-01-19 12:00:00' AND '2024-01-21 12:00:00')""",
        CONNS,
    )
    + "SELECT run_id, station, stop_num, next_station, dep, arr FROM conns WHERE dep >= '2024-01-20'",
    "known_at": _with(STOPS, KNOWN.format(now="2024-01-20 14:00:00")) + "SELECT run_id, stop_num, arr_delay, dep_delay FROM known",
    **{
        name: _with(STOPS, LOG, _last_known(*how)) + "SELECT run_id, stop_num, last_known_delay, minutes_since_known, stops_since_known FROM lk"
        for name, how in CUT.items()
    },
    "last_seen": _with(*ALL_LEGS, LOG, ROWS) + "SELECT request_id, run_id, stop_num, model, CAST(seen_delay AS BIGINT) AS seen_delay, minutes_ahead, cas AS case, grp AS group FROM rw".replace("AS case", 'AS "case"').replace("AS group", 'AS "group"'),
    "recent_local": _with(STOPS, KNOWN.format(now="2024-01-20 14:00:00"))
    + """SELECT station, run_id, stop_num, arr_delay, dep_delay FROM known
        WHERE greatest(planned_arr + to_minutes(arr_delay), planned_dep + to_minutes(dep_delay)) >= '2024-01-20 13:00:00'""",
    "baseline_global": _with(STOPS, QUERY, _history("arr", "qry", "h")) + f"SELECT run_id, stop_num, {Q6.format(q='overall')} FROM h",
    "baseline_train_station": _with(STOPS, QUERY, _history("arr", "qry", "h")) + f"SELECT run_id, stop_num, {Q6.format(q='usual')} FROM h",
    "baseline_carry_forward": _with(
        STOPS,
        LOG,
        QUERY,
        """ at_now AS (SELECT run_id, arg_max(delay, (time, i, NOT is_arr)) AS seen_delay FROM log WHERE time < TIMESTAMP '2024-01-20 14:00' GROUP BY run_id),
            sn AS (SELECT q.*, a.seen_delay FROM qry q LEFT JOIN at_now a ON a.run_id = q.run_id)""",
        _history("arr", "sn", "h"),
    )
    + f"""SELECT run_id, stop_num, {Q6.format(q="v")} FROM (SELECT *, CASE WHEN seen_delay IS NOT NULL AND usual IS NOT NULL
        THEN [seen_delay + (usual[1] - usual[1]), seen_delay + (usual[2] - usual[1]), seen_delay + (usual[3] - usual[1])] ELSE usual END AS v FROM h)""",
    "two_leg_journeys": _with(*ALL_LEGS) + "SELECT request_id, route, leg, run_id, from_station, from_stop_num, dep, to_station, to_stop_num, arr FROM legs",
    "route_stops_array": _with(*ALL_LEGS)
    + """SELECT request_id, route, leg, string_agg(s.station, ' ' ORDER BY s.stop_num) AS stops, count(*) AS n FROM legs JOIN stops s ON s.run_id = legs.run_id AND s.stop_num BETWEEN from_stop_num AND to_stop_num
        GROUP BY request_id, route, leg""",
    "replayed_transfers": _with(*ALL_LEGS)
    + """SELECT b.request_id, b.route, b.leg, b.from_station AS station, date_sub('minute', a.arr, b.dep) AS planned_min, date_sub('minute', l.arr_actual, e.dep_actual) AS actual_min,
        CASE WHEN l.arr_actual IS NULL OR e.dep_actual IS NULL THEN '?' WHEN e.dep_actual >= l.arr_actual AND NOT e.dep_canceled AND NOT l.arr_canceled THEN 'held' ELSE 'MISSED' END AS status
        FROM legs b JOIN legs a ON a.request_id = b.request_id AND a.route = b.route AND a.leg = b.leg - 1
        LEFT JOIN conns e ON e.run_id = b.run_id AND e.stop_num = b.from_stop_num LEFT JOIN conns l ON l.run_id = a.run_id AND l.next_stop_num = a.to_stop_num""",
    "transfer_probability": _with(*ALL_PRED, TRANSFERS) + "SELECT request_id, route, leg, room, round(wait, 6) AS wait, round(p, 6) AS p, level FROM tr WHERE method = 'train_station'",
    "transfer_levels": _with(*ALL_PRED, TRANSFERS) + "SELECT level, count(*) AS n, round(avg(p), 6) AS mean_p FROM tr WHERE method = 'train_station' GROUP BY level",
    "routes_ranked": _with(
        *ALL_PRED,
        TRANSFERS,
        """ lastleg AS (SELECT request_id, route, max_by((arr, run_id, to_stop_num), leg) AS l, min(dep) AS dep FROM legs GROUP BY request_id, route),
            w AS (SELECT request_id, route, count(*) AS transfers, max(level) AS weakest FROM tr WHERE method = 'train_station' GROUP BY request_id, route),
            rt AS (SELECT lastleg.request_id, lastleg.route, lastleg.dep, l[1] AS planned_arrival, p.q, coalesce(transfers, 0) AS transfers, coalesce(weakest, 1) AS weakest
                   FROM lastleg LEFT JOIN w ON w.request_id = lastleg.request_id AND w.route = lastleg.route
                   LEFT JOIN pred p ON p.method = 'train_station' AND p.model = 'arr' AND p.request_id = lastleg.request_id AND p.run_id = l[2] AND p.stop_num = l[3])""",
    )
    + """SELECT request_id, route, dep, planned_arrival, planned_arrival + to_minutes(CAST(ceil(q[1]) AS BIGINT)) AS arrival_q50, planned_arrival + to_minutes(CAST(ceil(q[2]) AS BIGINT)) AS arrival_q80,
        planned_arrival + to_minutes(CAST(ceil(q[3]) AS BIGINT)) AS arrival_q95, transfers, weakest, CAST(row_number() OVER (PARTITION BY request_id ORDER BY planned_arrival, transfers, route) AS INT) AS rank FROM rt""",
    "held_outcome": _with(*ALL_PRED, TRANSFERS, OUTCOME) + "SELECT request_id, route, leg, canceled, held FROM oc WHERE method = 'global'",
    "brier_by_method": _with(*ALL_PRED, TRANSFERS, OUTCOME) + "SELECT method, count(*) AS n, round(avg(pow(p - CAST(held AS INT), 2)), 6) AS brier FROM ok GROUP BY method",
    "level_calibration": _with(*ALL_PRED, TRANSFERS, OUTCOME)
    + "SELECT method, level, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(held AS INT)), 6) AS mean_held, round(count(*) / sum(count(*)) OVER (PARTITION BY method), 6) AS share FROM ok GROUP BY method, level",
    "pinball_scores": _with(*ALL_PRED, SCORED) + f"SELECT model, method, {SCORES} FROM scored GROUP BY model, method",
    "scores_by_group": _with(*ALL_PRED, SCORED) + f'SELECT model, grp AS "group", method, {SCORES} FROM scored GROUP BY model, grp, method',
    "score_grouping_sets": _with(*ALL_PRED, SCORED)
    + f'SELECT model, method, cas AS "case", grp AS "group", {SCORES} FROM scored GROUP BY GROUPING SETS ((model, method), (model, cas, method), (model, grp, method))',
    "loss_pivot": _with(*ALL_PRED, SCORED)
    + """SELECT request_id, run_id, stop_num, model, round(max((l50 + l80 + l95) / 3) FILTER (WHERE method = 'global'), 6) AS loss_global,
        round(max((l50 + l80 + l95) / 3) FILTER (WHERE method = 'train_station'), 6) AS loss_train_station, round(max((l50 + l80 + l95) / 3) FILTER (WHERE method = 'carry_forward'), 6) AS loss_carry_forward
        FROM scored GROUP BY request_id, run_id, stop_num, model""",
    "shared_requests": _with(*ALL_PRED, SCORED, " kept AS (SELECT * FROM scored WHERE method <> 'global' OR length(request_id) + stop_num <> 20)")
    + "SELECT request_id, count(*) AS n FROM kept GROUP BY request_id HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM kept)",
    "case_buckets": _with(*ALL_LEGS, LOG, ROWS) + 'SELECT model, cas AS "case", count(*) AS n, count(delay) AS with_delay FROM rw GROUP BY model, cas',
    "train_group_counts": _with(STOPS)
    + f'SELECT {GROUP} AS "group", count(DISTINCT run_id) AS runs, count(*) AS n_rows, count(arr_delay) AS arrivals, count(dep_delay) AS departures FROM stops GROUP BY 1',
    "busy_stations": _with(STOPS) + "SELECT station, count(*) AS departures FROM stops WHERE planned_dep IS NOT NULL GROUP BY station ORDER BY 2 DESC, 1 LIMIT 5",
    "stratified_runs": _with(STOPS, DRAWN_RUNS) + 'SELECT run_id, grp AS "group", n_rows FROM runs WHERE nth <= 60',
    "group_weights": _with(STOPS, DRAWN_RUNS, " g AS (SELECT grp, CAST(sum(n_rows) AS BIGINT) AS n_all, CAST(sum(n_rows) FILTER (WHERE nth <= 60) AS BIGINT) AS n_drawn FROM runs GROUP BY grp)")
    + 'SELECT grp AS "group", n_all, n_drawn, round(n_all / (SELECT sum(n_all) FROM g), 6) AS share, round(n_all / (SELECT sum(n_all) FROM g) / n_drawn, 9) AS weight FROM g',
    "display_labels": _with(STOPS, " l AS (SELECT *, (stop_num * 7 % 101) / 100.0 AS p FROM stops)")
    + """SELECT run_id, stop_num, CASE WHEN p >= 0.97 THEN '97% or more' WHEN p < 0.05 THEN 'under 5%' ELSE CAST(CAST(floor(p * 20) AS INT) * 5 AS VARCHAR) || '%' END AS text,
        CASE WHEN stop_num % 2 = 0 THEN station ELSE train_key END AS label FROM l""",
    "earliest_arrivals": _with(STOPS, CONNS, REACH) + "SELECT request_id, place AS station, ready AS arr FROM best3 WHERE NOT source",
}

ORACLE_SQL["leg_outcomes"] = _with(*ALL_LEGS) + """SELECT b.request_id, b.route, b.leg, b.run_id,
        CASE WHEN a.leg IS NULL THEN NULL WHEN l.arr_actual IS NULL OR e.dep_actual IS NULL THEN '?' WHEN e.dep_actual >= l.arr_actual AND NOT e.dep_canceled AND NOT l.arr_canceled THEN 'held' ELSE 'MISSED' END AS transfer_status
        FROM legs b LEFT JOIN legs a ON a.request_id = b.request_id AND a.route = b.route AND a.leg = b.leg - 1
        LEFT JOIN conns e ON e.run_id = b.run_id AND e.stop_num = b.from_stop_num LEFT JOIN conns l ON l.run_id = a.run_id AND l.next_stop_num = a.to_stop_num"""
ORACLE_SQL["legs_per_route"] = (
    _with(*ALL_LEGS, " per AS (SELECT request_id, route, count(*) AS legs, min_by(from_station, leg) AS src FROM legs GROUP BY ALL)")
    + """SELECT src, count(*) AS n, round(avg(legs), 9) AS mean, round(stddev_samp(legs), 9) AS std, min(legs) AS least,
        quantile_cont(CAST(legs AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(legs AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(legs AS DOUBLE), 0.75) AS p75, max(legs) AS most FROM per GROUP BY src"""
)
_DRAW = "(CAST('0x' || substr(md5(request_id || ':0:{of}'), 1, 13) AS BIGINT) / 4503599627370496.0)"
ORACLE_SQL |= {
    "drawn_requests": _with(
        STOPS,
        f""" busy AS (SELECT station, count(*) AS n FROM stops WHERE split = 'context' AND planned_dep IS NOT NULL GROUP BY station ORDER BY 2 DESC, 1 LIMIT 300),
            ends AS (SELECT station, n, CAST(coalesce(sum(n) OVER (ORDER BY n DESC, station ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM busy),
            whole AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM ends),
            ask AS (SELECT run_day AS day, k, CAST(CAST(run_day AS DATE) AS VARCHAR) || '-' || k AS request_id FROM (SELECT DISTINCT run_day FROM stops), range(30) r(k)),
            drew AS (SELECT *, CAST(floor({_DRAW.format(of="src")} * total) AS BIGINT) AS u FROM ask, whole),
            src AS (SELECT drew.*, station AS src, n, below FROM drew JOIN ends ON u >= below AND u < below + n),
            more AS (SELECT *, CAST(floor({_DRAW.format(of="dst")} * (total - n)) AS BIGINT) AS v0 FROM src WHERE total > n),
            v AS (SELECT *, CASE WHEN v0 >= below THEN v0 + n ELSE v0 END AS v FROM more)""",
    )
    + f"""SELECT request_id, day, src, e.station AS dst, day + to_minutes(CAST((6 + k % 17) * 60 + floor({_DRAW.format(of="minute")} * 60) AS BIGINT)) AS depart
        FROM v JOIN ends e ON v >= e.below AND v < e.below + e.n""",
    "day_timetables": _with(
        STOPS,
        """ near AS (SELECT s.*, d.day FROM stops s JOIN (SELECT DISTINCT run_day AS day FROM stops) d ON s.run_day BETWEEN d.day - INTERVAL 1 DAY AND d.day + INTERVAL 1 DAY
                     AND coalesce(planned_dep, planned_arr) BETWEEN d.day - INTERVAL 12 HOUR AND d.day + INTERVAL 36 HOUR),
            hops AS (SELECT *, lead(station) OVER w AS next_station, lead(planned_arr) OVER w AS arr FROM near WINDOW w AS (PARTITION BY day, run_id ORDER BY stop_num))""",
    )
    + "SELECT day, run_id, station, stop_num, next_station, planned_dep AS dep, arr FROM hops WHERE arr >= planned_dep AND planned_dep >= day",
}
ORACLE_SQL["training_history"] = _with(STOPS) + """SELECT d.day, train_type, count(*) AS n_rows, count(DISTINCT run_id) AS runs, CAST(sum(arr_delay) AS BIGINT) AS delays
    FROM (SELECT DISTINCT run_day AS day FROM stops) d JOIN stops s ON s.run_day < d.day AND s.run_day >= d.day - INTERVAL 14 DAY
    WHERE arr_delay IS NOT NULL AND NOT arr_canceled AND greatest(planned_arr, planned_dep, act_arr, act_dep) < d.day GROUP BY d.day, train_type"""

_DAYS = "(SELECT DISTINCT run_day AS day FROM stops)"
_NAME = "strftime({day}, '%Y-%m-%d') || '-' || train_type"
_CODE = "CASE WHEN {c} IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY request_id ORDER BY {c} NULLS LAST) - 1 AS INT) END AS {c}"
ORACLE_SQL |= {
    "slots_join": _with(
        STOPS,
        f""" q AS (SELECT DISTINCT run_day AS day, {_NAME.format(day="run_day")} AS request_id, station, ((coalesce(dep_hour * 60 + dep_minute, arr_hour * 60 + arr_minute) - b + 1440) % 1440) AS minute
                   FROM stops, range(1, 61) r(b) WHERE coalesce(planned_dep, planned_arr) IS NOT NULL)""",
    )
    + """SELECT request_id, q.station, count(*) AS n_rows, count(DISTINCT run_id) AS runs FROM q JOIN stops s ON s.station = q.station AND coalesce(dep_hour * 60 + dep_minute, arr_hour * 60 + arr_minute) = q.minute
        WHERE run_day < day AND run_day >= day - INTERVAL 7 DAY GROUP BY ALL""",
    "same_train_history": _with(STOPS)
    + f"""SELECT * FROM (SELECT day, train_key, CAST(row_number() OVER (PARTITION BY day, train_key ORDER BY run_day DESC, run_id, stop_num) AS INT) AS nth, run_id, stop_num
        FROM {_DAYS} d JOIN stops s ON run_day < day AND run_day >= day - INTERVAL 7 DAY AND (act_arr < day OR act_dep < day)
        WHERE EXISTS (SELECT 1 FROM stops t WHERE t.run_day = d.day AND t.train_key = s.train_key)) WHERE nth <= 20""",
    "all_stations": _with(STOPS, CONNS, " ends AS (SELECT station, run_day FROM conns UNION SELECT next_station, run_day FROM conns)")
    + "SELECT station, (SELECT nullif(count(*), 0) FROM ends e WHERE e.station = s.station) AS days FROM (SELECT DISTINCT station FROM stops) s",
    "coded_features": _with(
        STOPS,
        """ both_ AS (SELECT run_day AS day, true AS asked, * FROM stops WHERE planned_arr IS NOT NULL
                      UNION ALL SELECT run_day + INTERVAL 1 DAY, false, * FROM stops WHERE arr_delay IS NOT NULL AND NOT arr_canceled AND planned_arr IS NOT NULL)""",
        f""" named AS (SELECT *, {_NAME.format(day="day")} || '-' || CAST(CAST(floor(arr_hour / 4) AS INT) AS VARCHAR) AS request_id FROM both_)""",
    )
    + f"""SELECT request_id, run_id, stop_num, asked, CAST(arr_delay AS INT) AS target, {", ".join(_CODE.format(c=c) for c in ("train_type", "station", "train_key"))},
        CAST(weekday AS INT) AS weekday, CAST(run_planned_min AS INT) AS run_planned_min, CAST(n_stops AS INT) AS n_stops, CAST(arr_hour AS INT) AS arr_hour, CAST(arr_minute AS INT) AS arr_minute,
        CAST(date_diff('day', run_day, day) AS INT) AS days_ago, round(stop_frac, 6) AS stop_frac FROM named""",
}
