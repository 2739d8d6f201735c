"""Column names, constants and the schema of the stops relation."""

from __future__ import annotations

QUANTILES = (0.5, 0.8, 0.95)
QCOLS = tuple(f"q{round(100 * q)}" for q in QUANTILES)
CHANGE_MIN, MIN_TRANSFER_MIN = 2, 5
LEVEL_CUTS = (0.97, 0.8, 0.5)
PLAUSIBLE_MIN = 1200
HISTORY_DAYS, MIN_COUNT = 14, 10
WINDOW_MIN, DAYS_BACK, SAME_TRAIN_DAYS, CONTEXT_SIZE, POOL_PER_TYPE = 60, 7, 7, 10_000, 5_000
BUSY_STATIONS, FIRST_HOUR, LAST_HOUR, REQUESTS_PER_DAY = 300, 6, 22, 30
RUNS_PER_GROUP, ROWS_PER_TYPE, DRAWS = 60, 200_000, 2_000

#: One row per stop of a run; a run is one ride of one day.
STOPS = (
    "run_id string, run_day timestamp_ntz, split string, train_type string, train_key string, line_number string, final_destination string, "
    "station string, stop_num int, planned_arr timestamp_ntz, planned_dep timestamp_ntz, arr_canceled boolean, dep_canceled boolean, "
    "arr_delay short, dep_delay short, prev_station string, dwell_planned_min short, n_stops int, run_planned_min short, stop_frac double, "
    "arr_hour double, arr_minute double, dep_hour double, dep_minute double, weekday byte"
)
