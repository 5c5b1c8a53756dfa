"""Further queries: raw units, availability, probes, stored analyses, closed stream windows, with SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import snapshots
from paddock.functions.storage import shared_folder, stored
from paddock.operators import catalog, laps, sessions, traces
from paddock.plans import trace_queries
from paddock.plans.lap_queries import _BEST_SECTORS, _TABLES, snapshots as snapshot_view
from paddock.plans.session_queries import VALID_SQL, _gold_sql, _plain_times, _valid, query
from paddock.plans.views import LAPS_SQL, SECTORS_SQL, TRACE_SQL, trace
from paddock.plans.views import laps as laps_view
from paddock.plans.views import sectors as sectors_view
from paddock.sources import tables
from paddock.streaming import stages

#: Raw counters from events: single value or array of four
_RAW = {
    "gear_raw": "event_id % 8", "gas": "(event_id * 7 % 131) / 100e0 - 0.1e0", "brake_raw": "(event_id * 3 % 121) / 100e0", "steer_angle_rad": "(event_id % 63) / 50e0 - 0.6e0", "fuel_l": "(event_id % 50) - 3e0", "surface_grip": "(event_id % 13) / 10e0",
}
_RAW_SQL = "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in _RAW.items()) + " FROM events"


@query(
    "SELECT event_id, gear_raw - 1 AS vehicle_gear, least(1e0, greatest(0e0, gas)) AS vehicle_throttle, least(1e0, greatest(0e0, brake_raw)) "
    "AS vehicle_brake, degrees(steer_angle_rad) AS vehicle_steering_angle_deg, greatest(0e0, fuel_l) AS vehicle_fuel_l, "
    "least(1e0, greatest(0e0, surface_grip)) AS environment_grip_level, (event_id % 40 + 2) * 0.3e0 * 3.6e0 AS rl_wheel_speed_kmh, "
    f"(event_id % 9 + 3) / 100e0 * 1000e0 AS rr_suspension_travel_mm FROM ({_RAW_SQL})",
    "vehicle_throttle vehicle_brake vehicle_steering_angle_deg vehicle_fuel_l environment_grip_level rl_wheel_speed_kmh rr_suspension_travel_mm",
)
def b1_unit_normalisation(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *(F.expr(e).alias(n) for n, e in _RAW.items())).withColumnRenamed("brake_raw", "brake")
    zero = {c: F.lit(0.0) for c in ("speed_kmh", "rpm", "clutch", "lateral_g", "longitudinal_g", "brake_bias", "pitch_rad", "roll_rad", "air_temp_c", "road_temp_c")}
    four = {c: F.array(*[F.lit(1.0)] * 4) for c in ("wheel_pressure_psi", "tyre_temp_inner_c", "tyre_temp_middle_c", "tyre_temp_outer_c", "tyre_core_temp_c", "brake_temp_c", "wheel_load_n", "wheel_slip", "ride_height_m")}
    wheel = lambda e: F.array(*(F.expr(e.format(i)) for i in range(4)))
    made = {"wheel_angular_speed_rad_s": wheel("event_id % 40 + {}e0"), "tyre_radius_m": F.array(*[F.lit(0.3)] * 4), "suspension_travel_m": wheel("(event_id % 9 + {}) / 100e0")}
    return snapshots.to_frames(raw.withColumns(zero | four | made), ("event_id",)).select(
        "event_id", "vehicle_gear", "vehicle_throttle", "vehicle_brake", "vehicle_steering_angle_deg", "vehicle_fuel_l", "environment_grip_level", "rl_wheel_speed_kmh", "rr_suspension_travel_mm"
    )


@query("SELECT source_id, status, session_type, count(*) AS snapshots FROM (SELECT user_id AS source_id, CASE WHEN event_id % 13 = 0 THEN 'REPLAY' WHEN event_id % 17 = 0 THEN 'PAUSE' WHEN event_id % 29 = 0 THEN 'OFF' ELSE 'LIVE' END AS status, "
       "CASE (n // 40) % 3 WHEN 0 THEN 'practice' WHEN 1 THEN 'qualifying' ELSE 'race' END AS session_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)) GROUP BY ALL")  # fmt: skip
def b2_code_names(spark, sf_dir):
    return snapshot_view(spark, sf_dir).groupBy("source_id", "status", "session_type").agg(F.count("*").alias("snapshots"))


_REASON = (
    "CASE WHEN lap_key % 6 = 0 THEN 'missing_trace' WHEN lap_key % 7 = 0 THEN 'version_mismatch' WHEN lap_key % 5 = 0 THEN 'too_few_samples' "
    "WHEN lap_key % 11 = 0 THEN 'missing_file' END"
)


@query(f"SELECT session_id, lap_number, {_REASON} AS unavailable_reason FROM ({LAPS_SQL})")
def b13_trace_availability(spark, sf_dir):
    lap = laps_view(spark, sf_dir)
    key = F.col("lap_key")
    files = lap.where("lap_key % 6 != 0").select("session_id", "lap_number", F.when(key % 7 == 0, 2).otherwise(1).alias("schema_version"), (key % 5).alias("sample_count"), F.when(key % 11 != 0, F.lit("file")).alias("file_path"))
    return traces.availability(lap, files.withColumn("sample_count", F.when(F.col("sample_count") == 0, 1).otherwise(99)))


_STORED = ("average_speed_kmh", "maximum_speed_kmh", "fuel_used_l", "maximum_braking_g", "valid_row_percentage")


@query(
    "SELECT session_id, sample_count AS row_count, duration_seconds, sample_count AS stored_samples, 1 AS schema_version, "
    f"{', '.join(f'{m} AS stored_{m}' for m in _STORED)} FROM ({_gold_sql(VALID_SQL)})",
    "duration_seconds " + " ".join(f"stored_{m}" for m in _STORED),
)
def a26_metrics_store(spark, sf_dir):
    """Metrics of the stored JSON map beside the rows that it was made from."""
    store = catalog.metrics_store(sessions.gold_summary(_valid(spark, sf_dir), None))
    of = lambda m: F.get_json_object("metrics", f"$.{m}")
    return store.select("session_id", "row_count", "duration_seconds", of("sample_count").cast("long").alias("stored_samples"), "schema_version", *(of(m).cast("double").alias(f"stored_{m}") for m in _STORED))


@query(
    f"{_TABLES} SELECT session_id, CAST(sum(best_sector_time_ms) AS BIGINT) AS theoretical_best_ms FROM ({_BEST_SECTORS}) "
    f"WHERE session_id = (SELECT max(session_id) FROM ({_BEST_SECTORS})) GROUP BY session_id"
)
def e29_analysis_by_id(spark, sf_dir):
    """One stored report, looked up by its id."""
    history = laps.history(laps_view(spark, sf_dir), sectors_view(spark, sf_dir)).where("theoretical_best_ms is not null")
    kept = stored(catalog.store_analyses(history, F.concat(F.lit("a-"), "session_id"), F.lit("2024-01-01").cast("timestamp")), "analyses")
    wanted = kept.agg(F.max("analysis_id")).first()[0]
    return tables.get(kept, "analysis_id", wanted).select("session_id", F.get_json_object("report", "$.theoretical_best_ms").cast("long").alias("theoretical_best_ms"))


@query(
    f"SELECT l.session_id, l.lap_number, lap_time_ms, sector_number, sector_time_ms FROM ({LAPS_SQL}) l "
    f"JOIN ({SECTORS_SQL}) s ON s.session_id = l.session_id AND s.lap_number = l.lap_number WHERE l.session_id = (SELECT min(session_id) FROM ({LAPS_SQL}))"
)
def e30_listed_laps(spark, sf_dir):
    """Laps of a session and the sectors of each, by lookups."""
    lap = laps_view(spark, sf_dir)
    first = lap.agg(F.min("session_id")).first()[0]
    found = catalog.listed(lap, ("lap_number",), session_id=first).select("session_id", "lap_number", "lap_time_ms")
    return found.join(catalog.listed(sectors_view(spark, sf_dir), ("lap_number", "sector_number"), session_id=first), ["session_id", "lap_number"])


@query(
    f"{_TABLES} SELECT session_id, concat('a-', session_id) AS analysis_id, CAST(theoretical AS BIGINT) AS theoretical_best_ms "
    f"FROM (SELECT session_id, sum(best_sector_time_ms) AS theoretical FROM ({_BEST_SECTORS}) GROUP BY session_id) ORDER BY (SELECT max(occurred_at) "
    "FROM laps l WHERE l.session_id = session_id), analysis_id DESC LIMIT 15"
)
def e29_stored_analyses(spark, sf_dir):
    """Reports stored as JSON; the latest fifteen (all of one time, so by id)."""
    history = laps.history(laps_view(spark, sf_dir), sectors_view(spark, sf_dir)).where("theoretical_best_ms is not null")
    kept = catalog.store_analyses(history, F.concat(F.lit("a-"), "session_id"), F.lit("2024-01-01").cast("timestamp"))
    return catalog.recent_analyses(kept, 15).select("session_id", "analysis_id", F.get_json_object("report", "$.theoretical_best_ms").cast("long").alias("theoretical_best_ms"))


_COUNTS = f"SELECT session_id, lap_number, count(*) AS n, any_value(car_id) AS car_id FROM ({TRACE_SQL}) GROUP BY 1, 2"


_N = "CAST(substr(session_id, 2) AS BIGINT)"
_MISMATCH = (
    f"concat_ws(',', CASE WHEN {_N} % 4 = 0 THEN 'car' END, CASE WHEN {_N} % 6 = 0 THEN 'track' END, CASE WHEN lap_number = 2 THEN 'lap_time' END, CASE "
    f"WHEN lap_number = 3 OR {_N} % 5 = 0 THEN 'sample_count' END)"
)


@query(f"SELECT * FROM (SELECT session_id, lap_number, {_MISMATCH} AS mismatches FROM ({_COUNTS})) WHERE mismatches <> ''")
def e31_trace_consistency(spark, sf_dir):
    """Every kind of mismatch, alone and with others."""
    t = trace(spark, sf_dir)
    per_lap = t.groupBy(*traces.LAP).agg(F.count("*").alias("n"), F.first("car_id").alias("car_id"), F.first("track_id").alias("track_id")).withColumn("lap_time_ms", F.lit(1))
    number = F.substring("session_id", 2, 20).cast("long")
    wrong = (F.col("lap_number") == 3) | (number % 5 == 0)
    files = per_lap.withColumns({"sample_count": F.when(wrong, F.col("n") + 1).otherwise(F.col("n")), "lap_time_ms": F.when(F.col("lap_number") == 2, 2).otherwise(1)})
    owners = t.select("session_id", "car_id", "track_id").distinct()
    owners = owners.withColumns({"car_id": F.when(number % 4 == 0, "another").otherwise(F.col("car_id")), "track_id": F.when(number % 6 == 0, "another").otherwise(F.col("track_id"))})
    return traces.consistency(files, owners, per_lap, t).select(*traces.LAP, F.array_join("mismatches", ",").alias("mismatches"))


_PROBE = "SELECT session_id, ref_lap, target_lap, 0.21e0 + 0.03e0 * (target_lap % 5) AS position FROM pairs"


@query(
    "SELECT * REPLACE (round(time_delta_seconds + 1e-9, 6) AS time_delta_seconds) "
    f"FROM ({trace_queries._ALIGNED}, probes AS ({_PROBE}), pts AS (SELECT *, target_elapsed_seconds - ref_elapsed_seconds AS d, lag(progress) OVER w "
    "AS px, lag(target_elapsed_seconds - ref_elapsed_seconds) OVER w AS pd FROM aligned WINDOW w AS (PARTITION BY session_id, ref_lap, target_lap "
    "ORDER BY grid_index)) "
    "SELECT p.session_id, p.ref_lap, p.target_lap, round(p.position + 1e-9, 6) AS position, pd + (d - pd) * ((p.position - px) / (progress - px)) "
    "AS time_delta_seconds FROM probes p ASOF LEFT JOIN pts a ON a.session_id = p.session_id AND a.ref_lap = p.ref_lap AND a.target_lap = p.target_lap "
    "AND a.progress >= p.position)"
)
def e8_time_delta_probes(spark, sf_dir):
    analysis = trace_queries._analysis(spark, sf_dir)
    probes = analysis.pairs.withColumn("position", F.lit(0.21) + F.lit(0.03) * (F.col("target_lap") % 5))
    times = traces.time_deltas(probes, analysis.pairs, analysis.trace)
    return probes.join(times, [*traces.PAIR, "position"], "left")


#: The reference lap of a car and track: of complete laps the one of least time, ties by session and lap
_BEST = (
    "SELECT car_id, track_id, first(session_id ORDER BY e, session_id, lap_number) AS session_id, first(lap_number "
    f"ORDER BY e, session_id, lap_number) AS lap_number FROM (SELECT session_id, lap_number, car_id, track_id, max(elapsed_seconds) AS e FROM ({TRACE_SQL}) "
    "GROUP BY ALL HAVING count(*) = 100 AND car_id <> 'car4') GROUP BY car_id, track_id"
)
_REFERENCE = (
    "SELECT car_id, track_id, progress AS x, elapsed_seconds AS e, lag(progress) OVER w AS px, lag(elapsed_seconds) OVER w AS pe FROM t SEMI "
    "JOIN best USING (car_id, track_id, session_id, lap_number) WINDOW w AS (PARTITION BY car_id, track_id ORDER BY progress)"
)


_LIVE_SQL = (
    f"SELECT * REPLACE (round(delta_seconds + 1e-9, 6) AS delta_seconds) FROM (WITH t AS MATERIALIZED ({TRACE_SQL}), best AS ({_BEST}), r "
    f"AS MATERIALIZED ({_REFERENCE}), s AS (SELECT session_id, lap_number, sample_index, car_id, track_id, progress + 0.003e0 AS p, elapsed_seconds FROM t) "
    "SELECT s.session_id, s.lap_number, s.sample_index, s.elapsed_seconds - CASE WHEN p = x THEN e "
    "ELSE pe + (e - pe) * ((p - px) / (x - px)) END AS delta_seconds, CASE WHEN NOT EXISTS (SELECT 1 FROM best b "
    "WHERE b.car_id = s.car_id AND b.track_id = s.track_id) THEN 'incompatible' "
    "WHEN r.e IS NULL OR (px IS NULL AND p <> x) THEN 'not_covered' END AS unavailable_reason "
    "FROM s ASOF LEFT JOIN r ON r.car_id = s.car_id AND r.track_id = s.track_id AND r.x >= s.p)"
)


@query(_LIVE_SQL)
def e9_live_delta(spark, sf_dir):
    """All samples, a little further on, against the best complete lap of their car and track; one car has none."""
    return traces.live_delta(*_live(spark, sf_dir)).select(*_DELTA)


@query(_LIVE_SQL)
def h10_live_delta(spark, sf_dir):
    """The same on a stream of samples, which meets the stored reference laps."""
    samples, reference = _live(spark, sf_dir)
    run = f"{shared_folder(spark)}/deltas-{uuid.uuid4().hex}"
    samples.write.parquet(f"{run}/in")
    made = traces.live_delta(stages.read_stream(spark, f"{run}/in", samples.schema, 1000), stored(reference, "reference")).select(*_DELTA)
    stages.start(made, f"{run}/out", "deltas").awaitTermination()
    return spark.read.parquet(f"{run}/out/deltas")


_DELTA = ("session_id", "lap_number", "sample_index", "delta_seconds", "unavailable_reason")


def _live(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = trace(spark, sf_dir)
    whole = t.groupBy("session_id", "lap_number", "car_id", "track_id").agg(F.max("elapsed_seconds").alias("e"), F.count(F.lit(1)).alias("n")).where("n = 100 and car_id <> 'car4'")
    best = whole.groupBy("car_id", "track_id").agg(F.min(F.struct("e", "session_id", "lap_number")).alias("b")).select("car_id", "track_id", "b.session_id", "b.lap_number")
    reference = t.join(best, ["car_id", "track_id", "session_id", "lap_number"], "left_semi")
    samples = t.withColumn("progress", F.col("progress") + 0.003).select("session_id", "lap_number", "sample_index", "car_id", "track_id", "progress", "elapsed_seconds")
    return samples, reference


@query(
    "SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, session_id, car_id, track_id, count(*) AS sample_count, avg(vehicle_speed_kmh) "
    "AS average_speed_kmh, max(vehicle_speed_kmh) AS maximum_speed_kmh, avg(front_pressure_psi) AS average_front_pressure_psi "
    f"FROM (SELECT *, date_trunc('day', timestamp) AS window_start, max(timestamp) OVER () AS latest FROM ({VALID_SQL})) "
    "GROUP BY window_start, session_id, car_id, track_id HAVING window_start + INTERVAL 1 DAY <= max(latest) - INTERVAL 10 SECOND",
    "average_speed_kmh maximum_speed_kmh average_front_pressure_psi",
)
def h3_closed_windows(spark, sf_dir):
    """Daily windows of valid frames as a stream: those that the watermark has closed."""
    run = f"{shared_folder(spark)}/windows/{uuid.uuid4().hex}"
    valid = stored(_valid(spark, sf_dir), "valid")
    valid.write.parquet(f"{run}/in")
    made = stages.analytics(stages.read_stream(spark, f"{run}/in", valid.schema, 1000), "10 seconds", "1 day")
    stages.start(made, f"{run}/out", "analytics").awaitTermination()
    columns = ("window_start", "window_end", "session_id", "car_id", "track_id", "sample_count", "average_speed_kmh", "maximum_speed_kmh", "average_front_pressure_psi")
    return _plain_times(spark.read.parquet(f"{run}/out/analytics").select(*columns))
