"""Queries on telemetry frames: Silver, Gold and session reports, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import quality, sessions
from paddock.plans.oracle import rounded, rounded_sql
from paddock.plans.views import TELEMETRY_SQL, telemetry
from paddock.schemas import WHEELS

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: SQL before its doubles are rounded, for queries that build on others
UNROUNDED: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__], UNROUNDED[f.__name__] = rounded_sql(sql, doubles) if doubles else sql, sql
        return f

    return add


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.deduplicate(telemetry(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split(quality.audited(_once(spark, sf_dir)))[0]


ONCE_SQL = f"SELECT * FROM ({TELEMETRY_SQL}) QUALIFY row_number() OVER (PARTITION BY session_id, sample_index ORDER BY timestamp) = 1"
_FEATURE_SQL = ["vehicle_speed_kmh / 3.6e0 AS vehicle_speed_mps"]
for _name, _field in quality._AXLE.items():
    _of = lambda w, f=_field: f"abs({w}_{f})" if f == "slip_angle_deg" else f"{w}_{f}"
    _front, _rear = f"({_of('fl')} + {_of('fr')}) / 2e0", f"({_of('rl')} + {_of('rr')}) / 2e0"
    _FEATURE_SQL += [f"{_front} AS front_{_name}", f"{_rear} AS rear_{_name}", f"{_front} - {_rear} AS {quality._DELTA[_name]}"]
_FEATURE_SQL += [
    "(fl_load_n + rl_load_n) / 2e0 AS left_load_n", "(fr_load_n + rr_load_n) / 2e0 AS right_load_n", "(fl_load_n + rl_load_n) / 2e0 - (fr_load_n + rr_load_n) / 2e0 AS left_right_load_delta_n",
]
_FLAG_SQL = {
    "quality_missing_required": " OR ".join(f"{c} IS NULL" for c in quality.REQUIRED),
    "quality_invalid_controls": " OR ".join(f"coalesce({c} NOT BETWEEN 0 AND 1, true)" for c in quality.CONTROLS),
    "quality_invalid_grip": "coalesce(environment_grip_level NOT BETWEEN 0 AND 1, true)",
    "quality_invalid_physical": " OR ".join([f"coalesce({c} <= 0, false)" for c in quality.POSITIVE] + [f"coalesce({c} < 0, false)" for c in quality.NOT_NEGATIVE]),
}
_FLAGGED_SQL = f"SELECT *, {', '.join(_FEATURE_SQL)}, {', '.join(f'({e}) AS {c}' for c, e in _FLAG_SQL.items())} FROM ({ONCE_SQL})"
AUDIT_SQL = f"SELECT *, {' + '.join(f'CAST({c} AS INTEGER)' for c in _FLAG_SQL)} AS quality_issue_count, NOT ({' OR '.join(_FLAG_SQL)}) AS is_valid FROM ({_FLAGGED_SQL})"
VALID_SQL = f"SELECT * FROM ({AUDIT_SQL}) WHERE is_valid"

_FEATURES = ("vehicle_speed_mps", *(f"{a}_{n}" for n in quality._AXLE for a in ("front", "rear")), *quality._DELTA.values(), "left_load_n", "right_load_n", "left_right_load_delta_n")


@query(f"SELECT session_id, sample_index, {', '.join(_FEATURES)} FROM ({AUDIT_SQL})", " ".join(_FEATURES))
def b3_axle_features(spark, sf_dir):
    return quality.with_features(_once(spark, sf_dir)).select("session_id", "sample_index", *_FEATURES)


@query(f"SELECT session_id, sample_index, {', '.join(_FLAG_SQL)}, quality_issue_count, is_valid FROM ({AUDIT_SQL})")
def b4_quality_flags(spark, sf_dir):
    return quality.audited(_once(spark, sf_dir)).select("session_id", "sample_index", *quality.FLAGS, "quality_issue_count", "is_valid")


@query(f"SELECT session_id, sample_index, vehicle_throttle, vehicle_speed_kmh, fl_load_n, quality_issue_count FROM ({AUDIT_SQL}) WHERE NOT is_valid")
def b5_quarantine(spark, sf_dir):
    return quality.split(quality.audited(_once(spark, sf_dir)))[1].select("session_id", "sample_index", "vehicle_throttle", "vehicle_speed_kmh", "fl_load_n", "quality_issue_count")


@query(f"SELECT session_id, count(*) AS frames, count(DISTINCT sample_index) AS distinct_frames, max(timestamp) AS last_seen FROM ({ONCE_SQL}) GROUP BY session_id")
def b6_deduplicate(spark, sf_dir):
    return _once(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("frames"), F.countDistinct("sample_index").alias("distinct_frames"), F.max("timestamp").cast("timestamp_ntz").alias("last_seen"))


@query(f"SELECT session_id, CAST(CAST(min(timestamp) AS DATE) AS VARCHAR) AS date FROM ({ONCE_SQL}) GROUP BY session_id")
def b9_partition_date(spark, sf_dir):
    return quality.partition_dates(_once(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(
    "SELECT session_id, count(DISTINCT car_id) AS n_car_id, count(DISTINCT track_id) AS n_track_id, count(DISTINCT setup_id) AS n_setup_id, "
    f"count(DISTINCT car_id) = 1 AND count(DISTINCT track_id) = 1 AND count(DISTINCT setup_id) <= 1 AS is_single FROM ({TELEMETRY_SQL}) GROUP BY session_id"
)
def b10_identity_audit(spark, sf_dir):
    return quality.identity_audit(telemetry(spark, sf_dir))


_GOLD_DOUBLES = (
    "duration_seconds maximum_speed_kmh average_speed_kmh average_rpm average_throttle average_brake maximum_lateral_g maximum_braking_g fuel_used_l valid_row_percentage "
    + " ".join(f"average_{c}" for c in sessions._AVERAGES) + " " + " ".join(sessions._PEAKS.values())
)


def _gold_sql(source: str) -> str:
    return (
        "SELECT session_id, min(car_id) AS car_id, min(track_id) AS track_id, min(setup_id) AS setup_id, min(session_type) AS session_type, min(telemetry_source) AS telemetry_source, "
        "min(timestamp) AS started_at, max(timestamp) AS ended_at, max(elapsed_seconds) - min(elapsed_seconds) AS duration_seconds, count(*) AS sample_count, "
        "max(vehicle_speed_kmh) AS maximum_speed_kmh, "
        "avg(vehicle_speed_kmh) AS average_speed_kmh, avg(vehicle_rpm) AS average_rpm, avg(vehicle_throttle) AS average_throttle, avg(vehicle_brake) AS average_brake, "
        "max(abs(vehicle_lateral_g)) AS maximum_lateral_g, greatest(0e0, -min(vehicle_longitudinal_g)) AS maximum_braking_g, "
        "greatest(0e0, arg_min(vehicle_fuel_l, sample_index) - arg_max(vehicle_fuel_l, sample_index)) AS fuel_used_l, "
        + ", ".join(f"avg({c}) AS average_{c}" for c in sessions._AVERAGES) + ", " + ", ".join(f"max({c}) AS {n}" for c, n in sessions._PEAKS.items())
        + f", avg(CASE WHEN is_valid THEN 1e0 ELSE 0e0 END) * 100e0 AS valid_row_percentage FROM ({source}) GROUP BY session_id"
    )


def _plain_times(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock times, which is what the other engine has."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query(_gold_sql(VALID_SQL), _GOLD_DOUBLES)
def d1_gold_summary(spark, sf_dir):
    return _plain_times(sessions.gold_summary(_valid(spark, sf_dir), None))


@query(_gold_sql(AUDIT_SQL), _GOLD_DOUBLES)
def d1_gold_audit(spark, sf_dir):
    return _plain_times(sessions.gold_summary(quality.audited(_once(spark, sf_dir)), None))


_D2 = (*sessions._AVERAGES[:6], "front_slip_angle_deg", "rear_slip_angle_deg")


@query(
    "SELECT session_id, car_id, track_id, count(*) AS sample_count, max(elapsed_seconds) - min(elapsed_seconds) AS duration_seconds, "
    "max(vehicle_speed_kmh) AS maximum_speed_kmh, avg(vehicle_speed_kmh) AS average_speed_kmh, "
    + ", ".join(f"avg({c}) AS average_{c}" for c in _D2) + f", avg(CASE WHEN is_valid THEN 1e0 ELSE 0e0 END) * 100e0 AS valid_row_percentage FROM ({AUDIT_SQL}) GROUP BY session_id, car_id, track_id",
    "duration_seconds maximum_speed_kmh average_speed_kmh valid_row_percentage " + " ".join(f"average_{c}" for c in _D2),
)
def d2_sql_summary(spark, sf_dir):
    return sessions.sql_summary(quality.audited(_once(spark, sf_dir)))


@query(
    "SELECT session_id, count(*) AS sample_count, greatest(0e0, max(vehicle_speed_kmh)) AS maximum_speed_kmh, greatest(0e0, max(abs(vehicle_lateral_g))) "
    "AS maximum_lateral_g, greatest(0e0, -min(vehicle_longitudinal_g)) AS maximum_braking_g, "
    "greatest(0e0, arg_min(vehicle_fuel_l, sample_index) - arg_max(vehicle_fuel_l, sample_index)) AS fuel_used_l, arg_max(elapsed_seconds, "
    f"sample_index) - arg_min(elapsed_seconds, sample_index) AS duration_seconds FROM ({VALID_SQL}) GROUP BY session_id",
    "maximum_speed_kmh maximum_lateral_g maximum_braking_g fuel_used_l duration_seconds",
)
def d3_session_metrics(spark, sf_dir):
    return sessions.session_metrics(_valid(spark, sf_dir))


def _long_sql(fields: str, source: str = VALID_SQL) -> str:
    parts = (f"SELECT session_id, sample_index, __first, __last, '{w}' AS wheel, {', '.join(f'{w.lower()}_{f} AS {f}' for f in fields.split())} FROM ends" for w in WHEELS)
    ends = (
        "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sample_index) <= 20 AS __first, row_number() OVER (PARTITION BY session_id "
        f"ORDER BY sample_index DESC) <= 20 AS __last FROM ({source})"
    )
    return f"WITH ends AS ({ends}) " + " UNION ALL ".join(parts)


@query(
    "SELECT session_id, wheel, avg(pressure_psi) AS average_pressure_psi, avg(tyre_temp_core_c) AS average_core_temp_c, avg(brake_temp_c) "
    "AS average_brake_temp_c, avg(load_n) AS average_load_n, greatest(0e0, max(tyre_temp_core_c)) AS maximum_core_temp_c, "
    "greatest(0e0, max(brake_temp_c)) AS maximum_brake_temp_c, greatest(0e0, max(suspension_travel_mm)) AS maximum_suspension_travel_mm, "
    "max(abs(slip_ratio)) AS maximum_slip_ratio, max(abs(slip_angle_deg)) AS maximum_slip_angle_deg "
    f"FROM ({_long_sql('pressure_psi tyre_temp_core_c brake_temp_c load_n suspension_travel_mm slip_ratio slip_angle_deg')}) GROUP BY session_id, wheel",
    "average_pressure_psi average_core_temp_c average_brake_temp_c average_load_n maximum_core_temp_c maximum_brake_temp_c maximum_suspension_travel_mm maximum_slip_ratio maximum_slip_angle_deg",
)
def d3_wheel_metrics(spark, sf_dir):
    return sessions.wheel_metrics(_valid(spark, sf_dir))


_TYRE = "SELECT session_id, wheel, avg(pressure_psi) AS average_pressure_psi, " + ", ".join(f"avg(tyre_temp_{p}_c) AS average_{p}_temp_c" for p in ("inner", "middle", "outer", "core")) + (
    ", max(tyre_temp_core_c) AS peak_core_temp_c, avg(pressure_psi) FILTER (__first) AS starting_pressure_psi, avg(pressure_psi) FILTER (__last) AS ending_pressure_psi, "
    "avg(tyre_temp_core_c) FILTER (__first) AS starting_core_temp_c, avg(tyre_temp_core_c) FILTER (__last) AS ending_core_temp_c "
    f"FROM ({_long_sql('pressure_psi tyre_temp_inner_c tyre_temp_middle_c tyre_temp_outer_c tyre_temp_core_c')}) GROUP BY session_id, wheel"
)
_THREE = "average_inner_temp_c, average_middle_temp_c, average_outer_temp_c"


@query(
    "SELECT *, ending_pressure_psi - starting_pressure_psi AS pressure_gain_psi, average_inner_temp_c - average_outer_temp_c AS inner_outer_delta_c, "
    f"greatest({_THREE}) - least({_THREE}) AS thermal_spread_c, ending_core_temp_c - starting_core_temp_c AS warmup_gain_c FROM ({_TYRE})",
    "average_pressure_psi average_inner_temp_c average_middle_temp_c average_outer_temp_c average_core_temp_c peak_core_temp_c starting_pressure_psi ending_pressure_psi starting_core_temp_c ending_core_temp_c pressure_gain_psi inner_outer_delta_c thermal_spread_c warmup_gain_c",
)
def d4_tyre_report(spark, sf_dir):
    return sessions.tyre_report(_valid(spark, sf_dir))


_EVENTS_SQL = (
    "SELECT session_id, event_number, min(elapsed_seconds) AS started_at_seconds, arg_max(coalesce(next_elapsed, elapsed_seconds), sample_index) "
    "AS ended_at_seconds, count(*) AS sample_count, max(vehicle_brake) AS peak_brake, "
    "arg_max(coalesce(next_elapsed, elapsed_seconds), sample_index) - min(elapsed_seconds) AS duration_seconds FROM (SELECT *, sum(CASE "
    "WHEN braking AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY sample_index) AS event_number "
    "FROM (SELECT *, coalesce(lag(braking) OVER w, false) AS was FROM (SELECT *, vehicle_brake >= 0.1e0 AS braking, lead(elapsed_seconds) "
    "OVER (PARTITION BY session_id ORDER BY sample_index) AS next_elapsed "
    f"FROM ({VALID_SQL})) WINDOW w AS (PARTITION BY session_id ORDER BY sample_index))) WHERE braking GROUP BY session_id, event_number"
)


@query(f"SELECT * REPLACE (CAST(event_number AS BIGINT) AS event_number) FROM ({_EVENTS_SQL})", "started_at_seconds ended_at_seconds peak_brake duration_seconds")
def c10_braking_events(spark, sf_dir):
    return sessions.braking_events(_valid(spark, sf_dir))


_BRAKE_WHEELS = "average_temperature_c peak_temperature_c starting_temperature_c ending_temperature_c temperature_gain_c"


@query(
    "SELECT session_id, wheel, avg(brake_temp_c) AS average_temperature_c, max(brake_temp_c) AS peak_temperature_c, avg(brake_temp_c) FILTER (__first) "
    "AS starting_temperature_c, avg(brake_temp_c) FILTER (__last) AS ending_temperature_c, "
    f"avg(brake_temp_c) FILTER (__last) - avg(brake_temp_c) FILTER (__first) AS temperature_gain_c FROM ({_long_sql('brake_temp_c')}) GROUP BY session_id, wheel",
    _BRAKE_WHEELS,
)
def c13_first_last_windows(spark, sf_dir):
    return sessions.brake_wheels(_valid(spark, sf_dir))


@query(
    "SELECT session_id, count(*) AS sample_count, greatest(0e0, max(vehicle_brake)) AS maximum_brake_input, "
    "coalesce(avg(vehicle_brake) FILTER (vehicle_brake >= 0.1e0), 0e0) AS average_brake_input_during_events, "
    "(avg(fl_brake_temp_c) + avg(fr_brake_temp_c)) / 2 AS average_front_temperature_c, (avg(rl_brake_temp_c) + avg(rr_brake_temp_c)) / 2 AS average_rear_temperature_c, "
    "(avg(fl_brake_temp_c) + avg(fr_brake_temp_c)) / 2 - (avg(rl_brake_temp_c) + avg(rr_brake_temp_c)) / 2 AS front_rear_temperature_delta_c, "
    "coalesce(any_value(n), 0) AS braking_event_count, coalesce(any_value(d), 0e0) AS average_braking_event_duration_seconds "
    f"FROM ({VALID_SQL}) LEFT JOIN (SELECT session_id, count(*) AS n, avg(duration_seconds) AS d FROM ({_EVENTS_SQL}) GROUP BY session_id) USING (session_id) GROUP BY session_id",
    "maximum_brake_input average_brake_input_during_events average_front_temperature_c average_rear_temperature_c front_rear_temperature_delta_c average_braking_event_duration_seconds",
)
def d5_brake_report(spark, sf_dir):
    return sessions.brake_report(_valid(spark, sf_dir))


_SUSPENSION = (
    "SELECT session_id, wheel, avg(suspension_travel_mm) AS average_travel_mm, max(suspension_travel_mm) AS maximum_travel_mm, avg(load_n) "
    "AS average_load_n, max(load_n) AS maximum_load_n, min(load_n) AS minimum_load_n, "
    "CAST(sum(CASE WHEN suspension_travel_mm >= 75 AND NOT coalesce(before >= 75, false) THEN 1 ELSE 0 END) AS BIGINT) AS bottoming_event_count FROM "
    "(SELECT *, lag(suspension_travel_mm) OVER (PARTITION BY session_id, wheel ORDER BY sample_index) AS before "
    f"FROM ({_long_sql('suspension_travel_mm load_n')})) GROUP BY session_id, wheel"
)


@query(_SUSPENSION, "average_travel_mm maximum_travel_mm average_load_n maximum_load_n minimum_load_n")
def d6_suspension_report(spark, sf_dir):
    return sessions.suspension_report(_valid(spark, sf_dir))


def _of(wheel: str, column: str) -> str:
    return f"max({column}) FILTER (wheel = '{wheel}')"


_AXLE_PARTS = {
    "front_average_travel_mm": ("FL", "FR", "average_travel_mm"), "rear_average_travel_mm": ("RL", "RR", "average_travel_mm"),
    "left_average_load_n": ("FL", "RL", "average_load_n"), "right_average_load_n": ("FR", "RR", "average_load_n"),
}


@query(
    "SELECT *, front_average_travel_mm - rear_average_travel_mm AS front_rear_travel_delta_mm, left_average_load_n - right_average_load_n "
    "AS left_right_load_delta_n FROM (SELECT session_id, "
    + ", ".join(f"({_of(a, c)} + {_of(b, c)}) / 2 AS {n}" for n, (a, b, c) in _AXLE_PARTS.items()) + f", CAST(sum(bottoming_event_count) AS BIGINT) AS bottoming_event_count FROM ({_SUSPENSION}) GROUP BY session_id)",
    "front_average_travel_mm rear_average_travel_mm left_average_load_n right_average_load_n front_rear_travel_delta_mm left_right_load_delta_n",
)
def d6_suspension_axles(spark, sf_dir):
    return sessions.suspension_axles(_valid(spark, sf_dir))


_STATE_SQL = (
    "SELECT *, CASE WHEN abs(vehicle_lateral_g) < 0.3e0 THEN 'straight' WHEN f - r > 0.5e0 THEN 'front' WHEN f - r < -0.5e0 THEN 'rear' ELSE 'neutral' END AS state FROM "
    f"(SELECT *, (abs(fl_slip_angle_deg) + abs(fr_slip_angle_deg)) / 2 AS f, (abs(rl_slip_angle_deg) + abs(rr_slip_angle_deg)) / 2 AS r FROM ({VALID_SQL}))"
)
_SHARE = "coalesce(count(*) FILTER (state = '{0}') * 1e0 / nullif(count(*) FILTER (state <> 'straight'), 0) * 100, 0e0)"


@query(
    "SELECT session_id, count(*) AS sample_count, count(*) FILTER (state <> 'straight') AS cornering_sample_count, greatest(0e0, "
    "max(abs(vehicle_lateral_g))) AS maximum_lateral_g, greatest(0e0, max(vehicle_longitudinal_g)) AS maximum_acceleration_g, "
    "greatest(0e0, -min(vehicle_longitudinal_g)) AS maximum_braking_g, avg(abs(vehicle_steering_angle_deg)) AS average_absolute_steering_deg, "
    "max(abs(vehicle_steering_angle_deg)) AS maximum_absolute_steering_deg, "
    "coalesce(avg(f) FILTER (state <> 'straight'), 0e0) AS average_front_slip_angle_deg, coalesce(avg(r) FILTER (state <> 'straight'), 0e0) AS average_rear_slip_angle_deg, "
    "count(*) FILTER (state = 'front' AND coalesce(before, 'neutral') <> 'front') AS front_limited_event_count, count(*) FILTER (state = 'rear' "
    "AND coalesce(before, 'neutral') <> 'rear') AS rear_limited_event_count, "
    "coalesce(avg(f) FILTER (state <> 'straight'), 0e0) - coalesce(avg(r) FILTER (state <> 'straight'), 0e0) AS front_rear_slip_delta_deg, "
    + f"{_SHARE.format('front')} AS front_limited_percentage, {_SHARE.format('rear')} AS rear_limited_percentage, {_SHARE.format('neutral')} AS neutral_balance_percentage "
    + f"FROM (SELECT *, lag(state) OVER (PARTITION BY session_id ORDER BY sample_index) AS before FROM ({_STATE_SQL})) GROUP BY session_id",
    "maximum_lateral_g maximum_acceleration_g maximum_braking_g average_absolute_steering_deg maximum_absolute_steering_deg average_front_slip_angle_deg average_rear_slip_angle_deg front_rear_slip_delta_deg front_limited_percentage rear_limited_percentage neutral_balance_percentage",
)
def d7_dynamics_report(spark, sf_dir):
    return sessions.dynamics_report(_valid(spark, sf_dir))


@query(
    "SELECT session_id, min(timestamp) AS started_at, max(timestamp) AS ended_at, count(*) AS sample_count, max(elapsed_seconds) AS duration_seconds, "
    "arg_min(environment_track_temperature_c, sample_index) AS initial_track_c, "
    f"arg_max(environment_track_temperature_c, sample_index) AS final_track_c FROM ({ONCE_SQL}) GROUP BY session_id",
    "duration_seconds initial_track_c final_track_c",
)
def c7_session_rollup(spark, sf_dir):
    out = sessions.rollup(_once(spark, sf_dir))
    ends = {"initial_track_c": F.col("initial_conditions.track_temperature_c"), "final_track_c": F.col("final_conditions.track_temperature_c")}
    return _plain_times(out.withColumns(ends).drop("initial_conditions", "final_conditions"))
