"""Queries on lap traces and pairs of laps, with SQL where it expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import matching, rules, traces, zones
from paddock.plans import pair_sql
from paddock.plans.lap_pair_pipeline import LapPairAnalysis
from paddock.plans.session_queries import query
from paddock.plans.views import PAIRS_SQL, TRACE_SQL, pairs, trace

_LAP, _PAIR = "session_id, lap_number", "session_id, ref_lap, target_lap"
_T = f"WITH t AS MATERIALIZED ({TRACE_SQL})"


def _replace(sql: str, doubles: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in doubles.split())}) FROM ({sql})"


@query(
    _replace(
        f"{_T} SELECT {_LAP}, count(*) AS samples, min(progress) AS start, max(progress) AS \"end\", max(gap) AS largest_gap, first(before "
        "ORDER BY gap DESC NULLS LAST, progress) FILTER (gap IS NOT NULL) AS gap_start, "
        "first(progress ORDER BY gap DESC NULLS LAST, progress) FILTER (gap IS NOT NULL) AS gap_end "
        f"FROM (SELECT *, lag(progress) OVER w AS before, progress - lag(progress) OVER w AS gap FROM t WINDOW w AS (PARTITION BY {_LAP} ORDER BY progress, sample_index)) GROUP BY {_LAP}",
        "largest_gap gap_start gap_end",
    )
)
def d14_trace_coverage(spark, sf_dir):
    return traces.coverage(trace(spark, sf_dir))


#: One fault for each reason, in samples that a rule picks; the same in both forms
_FAULTS = {
    "progress": "CASE WHEN k % 31 = 5 THEN progress + 2e0 ELSE progress END",
    "throttle": "CASE WHEN k % 37 = 6 THEN -0.5e0 ELSE throttle END",
    "brake": "brake + 0.3e0",
    "elapsed_seconds": "CASE WHEN k % 41 = 7 THEN -1e0 ELSE elapsed_seconds END",
    "speed_kmh": "CASE WHEN k % 43 = 8 THEN -1e0 ELSE speed_kmh END",
    "steering_angle_deg": "CASE WHEN k % 47 = 9 THEN NULL ELSE steering_angle_deg END",
    "gear": "CASE WHEN k % 53 = 10 THEN -2 ELSE gear END",
    "clutch": "clutch + 0.3e0",
}
_FAULTY = f"SELECT session_id, lap_number, sample_index, {', '.join(f'{e} AS {c}' for c, e in _FAULTS.items())} FROM (SELECT *, sample_index + lap_number AS k FROM ({{0}}))"
_REASONS = {
    "progress": "NOT progress BETWEEN 0 AND 1", "throttle": "NOT throttle BETWEEN 0 AND 1", "brake": "NOT brake BETWEEN 0 AND 1", "elapsed": "elapsed_seconds < 0", "speed": "speed_kmh < 0",
    "steering": "steering_angle_deg IS NULL", "clutch": "NOT clutch BETWEEN 0 AND 1", "gear": "gear < -1", "progress_order": "progress <= lag(progress) OVER w", "elapsed_order": "elapsed_seconds < lag(elapsed_seconds) OVER w",
}


@query(
    "SELECT session_id, lap_number, sample_index, reason FROM (SELECT session_id, lap_number, sample_index, unnest([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _REASONS.items()) + "]) AS reason "
    f"FROM ({_FAULTY.format(TRACE_SQL)}) WINDOW w AS (PARTITION BY session_id, lap_number ORDER BY sample_index)) WHERE reason IS NOT NULL"
)
def b12_trace_violations(spark, sf_dir):
    faulty = trace(spark, sf_dir).withColumn("k", F.col("sample_index") + F.col("lap_number")).withColumns({c: F.expr(e) for c, e in _FAULTS.items()})
    return traces.violations(faulty).select("session_id", "lap_number", "sample_index", F.explode("reasons").alias("reason"))


_P = (
    f"{_T}, pairs AS (SELECT DISTINCT session_id, 1 AS ref_lap, lap_number AS target_lap FROM t "
    f"WHERE lap_number >= 2), ends AS (SELECT {_LAP}, min(progress) AS lo, max(progress) AS hi FROM t GROUP BY {_LAP}), "
)
_P += (
    f"shared AS (SELECT {_PAIR}, greatest(r.lo, g.lo) AS lo, least(r.hi, g.hi) AS hi, greatest(0e0, least(r.hi, g.hi) - greatest(r.lo, g.lo)) AS span "
    "FROM pairs p JOIN ends r USING (session_id) JOIN ends g USING (session_id) WHERE r.lap_number = ref_lap AND g.lap_number = target_lap)"
)
_SEGMENTS = f"segs AS (SELECT {_LAP}, progress AS x, lag(progress) OVER w AS px, " + ", ".join(f"{c} AS {c}, lag({c}) OVER w AS p_{c}" for c in traces.CHANNELS) + f" FROM t WINDOW w AS (PARTITION BY {_LAP} ORDER BY progress))"
_GRID = (
    f"grid AS (SELECT {_PAIR}, CAST(i AS INTEGER) AS grid_index, CASE WHEN i = 200 THEN hi ELSE least(hi, lo + span / 200 * i) END AS progress "
    "FROM shared, range(201) g(i) WHERE span > 0)"
)


def _at(side: str, c: str) -> str:
    return f"CASE WHEN {side}.x = g.progress THEN {side}.{c} ELSE {side}.p_{c} + ({side}.{c} - {side}.p_{c}) * ((g.progress - {side}.px) / ({side}.x - {side}.px)) END"


_ALIGNED = (
    f"{_P}, {_SEGMENTS}, {_GRID}, aligned AS MATERIALIZED (SELECT {', '.join('g.' + c for c in _PAIR.split(', '))}, g.grid_index, g.progress, "
    + ", ".join(f"{_at('r', c)} AS ref_{c}, {_at('q', c)} AS target_{c}" for c in traces.CHANNELS)
    + " FROM grid g ASOF JOIN segs r ON r.session_id = g.session_id AND r.lap_number = g.ref_lap AND r.x >= g.progress ASOF JOIN segs q ON q.session_id = g.session_id AND q.lap_number = g.target_lap AND q.x >= g.progress)"
)
_ALIGNED_DOUBLES = "progress " + " ".join(f"{s}_{c}" for c in traces.CHANNELS for s in ("ref", "target"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return traces.align(pairs(t), t)


@query(_replace(f"{_ALIGNED} SELECT {_PAIR}, grid_index, {_ALIGNED_DOUBLES.replace(' ', ', ')} FROM aligned", _ALIGNED_DOUBLES))
def e7_aligned_laps(spark, sf_dir):
    return _aligned(spark, sf_dir).select(*traces.PAIR, "grid_index", *_ALIGNED_DOUBLES.split())


@query(
    _replace(
        f"{_ALIGNED} SELECT {_PAIR}, arg_max(target_elapsed_seconds - ref_elapsed_seconds, grid_index) AS final_time_delta_seconds, "
        "avg(target_speed_kmh - ref_speed_kmh) AS mean_speed_delta_kmh, "
        "first(progress ORDER BY target_speed_kmh - ref_speed_kmh, grid_index) AS largest_speed_loss_progress, first(progress "
        "ORDER BY ref_speed_kmh - target_speed_kmh, grid_index) AS largest_speed_gain_progress "
        f"FROM aligned GROUP BY {_PAIR}",
        "final_time_delta_seconds mean_speed_delta_kmh largest_speed_loss_progress largest_speed_gain_progress",
    )
)
def e7_alignment_summary(spark, sf_dir):
    return traces.alignment_summary(_aligned(spark, sf_dir))


_RESAMPLED = ("progress", "speed_kmh", "throttle", "brake", "steering_angle_deg", "clutch")
_PROBE = "p AS (SELECT session_id, lap_number, CAST(i AS INTEGER) AS probe, i * 7.3e0 AS elapsed_seconds FROM (SELECT DISTINCT session_id, lap_number FROM t), range(12) r(i))"
_TIMES = (
    f"s AS (SELECT {_LAP}, elapsed_seconds AS x, lag(elapsed_seconds) OVER w AS px, lead(elapsed_seconds) OVER w IS NULL AS final, gear, lag(gear) OVER w "
    f"AS p_gear, {', '.join(f'{c}, lag({c}) OVER w AS p_{c}' for c in _RESAMPLED)} FROM t WINDOW w AS (PARTITION BY {_LAP} ORDER BY elapsed_seconds))"
)
_LERP = "CASE WHEN p.elapsed_seconds >= s.x OR s.px IS NULL THEN s.{0} ELSE s.p_{0} + (s.{0} - s.p_{0}) * ((p.elapsed_seconds - s.px) / (s.x - s.px)) END AS {0}"


@query(
    _replace(
        f"{_T}, {_PROBE}, {_TIMES} SELECT p.session_id, p.lap_number, probe, {', '.join(_LERP.format(c) for c in _RESAMPLED)}, CASE "
        "WHEN p.elapsed_seconds >= s.x OR s.px IS NULL THEN s.gear ELSE s.p_gear END AS gear FROM p "
        "JOIN s ON p.session_id = s.session_id AND p.lap_number = s.lap_number "
        "AND ((s.px IS NULL AND p.elapsed_seconds <= s.x) OR (s.px < p.elapsed_seconds AND p.elapsed_seconds <= s.x) OR (s.final AND p.elapsed_seconds > s.x))",
        " ".join(_RESAMPLED),
    )
)
def e10_resample_by_time(spark, sf_dir):
    t = trace(spark, sf_dir)
    times = t.select(*traces.LAP).distinct().select(*traces.LAP, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i * F.lit(7.3))).alias("probe", "elapsed_seconds"))
    return traces.resample(t, times).select(*traces.LAP, "probe", "gear", *_RESAMPLED)


_ON = (
    f"SELECT *, sum(CASE WHEN brake >= 0.1e0 AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY {_LAP} "
    f"ORDER BY progress, sample_index) AS run FROM (SELECT *, lag(brake >= 0.1e0) OVER (PARTITION BY {_LAP} ORDER BY progress, sample_index) AS was FROM t)"
)
_ZONES = (
    f"zones AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY {_LAP} ORDER BY run) AS INTEGER) AS zone_number "
    f"FROM (SELECT {_LAP}, run, min(progress) AS start_progress, max(progress) AS end_progress, min(elapsed_seconds) AS start_elapsed_seconds, "
    "max(elapsed_seconds) AS end_elapsed_seconds, "
    "arg_min(speed_kmh, sample_index) AS entry_speed_kmh, min(speed_kmh) AS minimum_speed_kmh, arg_max(speed_kmh, sample_index) AS exit_speed_kmh, "
    "max(brake) AS peak_brake, avg(brake) AS mean_brake, count(*) AS sample_count, (min(progress) + max(progress)) / 2 AS center_progress, "
    f"max(elapsed_seconds) - min(elapsed_seconds) AS duration_seconds FROM ({_ON}) WHERE brake >= 0.1e0 GROUP BY {_LAP}, run HAVING count(*) >= 2))"
)
_ZONE_DOUBLES = (
    "start_progress end_progress start_elapsed_seconds end_elapsed_seconds entry_speed_kmh minimum_speed_kmh exit_speed_kmh peak_brake mean_brake center_progress duration_seconds"
)


@query(_replace(f"{_T}, {_ZONES} SELECT * EXCLUDE (run) FROM zones", _ZONE_DOUBLES))
def e11_braking_zones(spark, sf_dir):
    return zones.braking_zones(trace(spark, sf_dir))


_WITHIN = (
    "e1 AS (SELECT t.*, z.zone_number, z.start_progress, z.end_progress, z.end_elapsed_seconds, row_number() OVER (PARTITION BY t.session_id, "
    "t.lap_number, z.zone_number ORDER BY progress, sample_index) AS n FROM t JOIN zones z ON t.session_id = z.session_id AND t.lap_number = z.lap_number "
    "AND progress BETWEEN z.start_progress AND least(1e0, z.end_progress + 0.08e0)), e2 AS (SELECT * "
    "FROM (SELECT *, min(n) FILTER (abs(steering_angle_deg) >= 5) OVER (PARTITION BY session_id, lap_number, zone_number) AS turn FROM e1) "
    "WHERE n >= turn), "
    "e3 AS (SELECT *, first_value(n) OVER (PARTITION BY session_id, lap_number, zone_number "
    "ORDER BY speed_kmh, progress, n) AS apex, count(*) OVER (PARTITION BY session_id, lap_number, zone_number) AS left_over FROM e2), "
    "entries AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, lap_number "
    "ORDER BY source_braking_zone_number) AS INTEGER) AS entry_number FROM (SELECT session_id, lap_number, zone_number AS source_braking_zone_number, "
    "min(progress) AS turn_in_progress, max(progress) AS apex_progress, "
    "max(elapsed_seconds) - min(elapsed_seconds) AS entry_duration_seconds, greatest(0e0, any_value(end_elapsed_seconds) - min(elapsed_seconds)) "
    "AS brake_overlap_seconds, arg_min(speed_kmh, n) AS entry_speed_kmh, arg_max(speed_kmh, n) AS apex_speed_kmh, greatest(0e0, arg_min(speed_kmh, "
    "n) - arg_max(speed_kmh, n)) AS speed_loss_kmh, "
    "arg_min(brake, n) AS brake_at_turn_in, arg_min(throttle, n) AS throttle_at_turn_in, arg_max(throttle, n) AS throttle_at_apex, "
    "max(abs(steering_angle_deg)) AS maximum_abs_steering_deg, avg(abs(steering_angle_deg)) AS average_abs_steering_deg, count(*) AS sample_count FROM e3 "
    "WHERE left_over >= 2 AND n <= apex GROUP BY 1, 2, 3 HAVING count(*) >= 2))"
)
_ENTRY_DOUBLES = (
    "turn_in_progress apex_progress entry_duration_seconds brake_overlap_seconds entry_speed_kmh apex_speed_kmh speed_loss_kmh brake_at_turn_in throttle_at_turn_in throttle_at_apex maximum_abs_steering_deg average_abs_steering_deg"
)
_ENTRY_COLUMNS = ("session_id", "lap_number", "entry_number", "source_braking_zone_number", "sample_count", *_ENTRY_DOUBLES.split())


def _entries(t: DataFrame) -> DataFrame:
    return zones.corner_entries(t, zones.braking_zones(t))


@query(_replace(f"{_T}, {_ZONES}, {_WITHIN} SELECT * FROM entries", _ENTRY_DOUBLES))
def e12_corner_entries(spark, sf_dir):
    return _entries(trace(spark, sf_dir)).select(*_ENTRY_COLUMNS)


_EXITS = (
    "x1 AS (SELECT t.*, e.entry_number, row_number() OVER (PARTITION BY t.session_id, t.lap_number, e.entry_number ORDER BY progress, sample_index) AS n "
    "FROM t JOIN entries e ON t.session_id = e.session_id AND t.lap_number = e.lap_number AND progress BETWEEN e.apex_progress AND least(1e0, "
    "e.apex_progress + 0.12e0)), "
    "x2 AS (SELECT *, min(n) FILTER (throttle >= 0.2e0) OVER (PARTITION BY session_id, lap_number, entry_number) AS open FROM x1), "
    "x3 AS (SELECT * FROM (SELECT *, min(n) FILTER (n >= open AND throttle >= 0.7e0 AND abs(steering_angle_deg) <= 8) OVER (PARTITION BY session_id, "
    "lap_number, entry_number) AS done FROM x2) WHERE n <= done), "
    "exits AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, lap_number ORDER BY source_entry_number) AS INTEGER) AS exit_number "
    "FROM (SELECT session_id, lap_number, entry_number AS source_entry_number, min(progress) AS apex_progress, max(progress) AS exit_progress, "
    "max(elapsed_seconds) - min(elapsed_seconds) AS duration_seconds, "
    "max(progress) FILTER (n = open) AS throttle_application_progress, max(elapsed_seconds) FILTER (n = open) - min(elapsed_seconds) "
    "AS time_to_throttle_seconds, arg_min(speed_kmh, n) AS apex_speed_kmh, arg_max(speed_kmh, n) AS exit_speed_kmh, arg_max(speed_kmh, "
    "n) - arg_min(speed_kmh, n) AS speed_gain_kmh, "
    "arg_max(throttle, n) AS throttle_at_exit, abs(arg_max(steering_angle_deg, n)) AS abs_steering_at_exit_deg, greatest(0e0, "
    "abs(arg_min(steering_angle_deg, n)) - abs(arg_max(steering_angle_deg, n))) AS steering_unwind_deg, max(elapsed_seconds) AS exit_elapsed_seconds, "
    "count(*) AS sample_count FROM x3 GROUP BY 1, 2, 3 HAVING count(*) >= 2))"
)
_EXIT_DOUBLES = (
    "apex_progress exit_progress duration_seconds throttle_application_progress time_to_throttle_seconds apex_speed_kmh exit_speed_kmh speed_gain_kmh throttle_at_exit abs_steering_at_exit_deg steering_unwind_deg exit_elapsed_seconds"
)


@query(_replace(f"{_T}, {_ZONES}, {_WITHIN}, {_EXITS} SELECT * FROM exits", _EXIT_DOUBLES))
def e13_corner_exits(spark, sf_dir):
    t = trace(spark, sf_dir)
    return zones.corner_exits(t, _entries(t)).select(*traces.LAP, "exit_number", "source_entry_number", "sample_count", *_EXIT_DOUBLES.split())


_CORNER_DOUBLES = "start_progress turn_in_progress apex_progress throttle_application_progress exit_progress minimum_speed_kmh apex_speed_kmh exit_speed_kmh total_duration_seconds"
_CORNERS = (
    "corners AS (SELECT z.session_id, z.lap_number, z.zone_number, e.entry_number, x.exit_number, z.start_progress, e.turn_in_progress, e.apex_progress, "
    "x.throttle_application_progress, x.exit_progress, z.minimum_speed_kmh, e.apex_speed_kmh, x.exit_speed_kmh, "
    "greatest(0e0, x.exit_elapsed_seconds - z.start_elapsed_seconds) AS total_duration_seconds, CAST(row_number() OVER (PARTITION BY z.session_id, "
    "z.lap_number ORDER BY e.apex_progress, z.zone_number) AS INTEGER) AS corner_number FROM zones z "
    "JOIN entries e ON e.session_id = z.session_id AND e.lap_number = z.lap_number AND e.source_braking_zone_number = z.zone_number "
    "JOIN exits x ON x.session_id = z.session_id AND x.lap_number = z.lap_number AND x.source_entry_number = e.entry_number "
    "WHERE z.start_progress <= e.turn_in_progress AND e.turn_in_progress <= e.apex_progress AND e.apex_progress <= x.exit_progress "
    "AND abs(e.apex_progress - x.apex_progress) <= 0.02e0)"
)


def _parts(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    zone = zones.braking_zones(t)
    entry = zones.corner_entries(t, zone)
    return zone, entry, zones.corner_exits(t, entry)


@query(_replace(f"{_T}, {_ZONES}, {_WITHIN}, {_EXITS}, {_CORNERS} SELECT * FROM corners", _CORNER_DOUBLES))
def e18_corners(spark, sf_dir):
    return zones.corners(*_parts(trace(spark, sf_dir))).select(*traces.LAP, "corner_number", "zone_number", "entry_number", "exit_number", *_CORNER_DOUBLES.split())


@query(
    f"{_T}, {_ZONES}, {_WITHIN}, {_EXITS}, {_CORNERS} SELECT {_LAP}, 'zone' AS part, zone_number AS number FROM zones ANTI "
    f"JOIN corners USING (session_id, lap_number, zone_number) UNION ALL SELECT {_LAP}, 'entry', entry_number FROM entries ANTI "
    "JOIN corners USING (session_id, lap_number, entry_number) "
    f"UNION ALL SELECT {_LAP}, 'exit', exit_number FROM exits ANTI JOIN corners USING (session_id, lap_number, exit_number)"
)
def e18_unchained_parts(spark, sf_dir):
    parts = _parts(trace(spark, sf_dir))
    return zones.unchained(*parts, zones.corners(*parts))


def _analysis(spark: SparkSession, sf_dir: str) -> LapPairAnalysis:
    t = trace(spark, sf_dir)
    return LapPairAnalysis(pairs(t), t)


_PARTS = f"{_ALIGNED}, {_ZONES}, {_WITHIN}, {_EXITS}, {_CORNERS}"
_CHAIN = pair_sql.chain(_PARTS)


@query(f"{_CHAIN} SELECT * FROM zone_delta", pair_sql.doubles("zone"))
def e15_zone_deltas(spark, sf_dir):
    return _analysis(spark, sf_dir).zone_deltas


@query(f"{_CHAIN} SELECT * FROM entry_delta", pair_sql.doubles("entry"))
def e16_entry_deltas(spark, sf_dir):
    return _analysis(spark, sf_dir).entry_deltas


@query(f"{_CHAIN} SELECT * FROM exit_delta", pair_sql.doubles("exit"))
def e17_exit_deltas(spark, sf_dir):
    return _analysis(spark, sf_dir).exit_deltas


@query(f"{_CHAIN} {pair_sql.LOSSES}", pair_sql.doubles("corner"))
def e19_corner_deltas(spark, sf_dir):
    return _analysis(spark, sf_dir).corner_deltas


@query(f"{_CHAIN} {pair_sql.unmatched('zone', 'zones')}")
def e20_unmatched_zones(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return matching.unmatched(a.pairs, a.zones, "zone_number", matching.match_zones(a.pairs, a.zones)[1])


@query(f"{_CHAIN} {pair_sql.unmatched('entry', 'entries')}")
def e20_unmatched_entries(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return matching.unmatched(a.pairs, a.entries, "entry_number", matching.match_entries(a.pairs, a.entries)[1])


@query(f"{_CHAIN} {pair_sql.unmatched('exit', 'exits')}")
def e20_unmatched_exits(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return matching.unmatched(a.pairs, a.exits, "exit_number", matching.match_exits(a.pairs, a.exits)[1])


@query(f"{_CHAIN} {pair_sql.unmatched('corner', 'corners')}")
def e20_unmatched_corners(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return matching.unmatched(a.pairs, a.corners, "corner_number", matching.match_corners(a.pairs, a.corners)[1])


def _flat(issues: DataFrame) -> DataFrame:
    first = F.col("evidence")[0]
    return issues.withColumns({"evidence_count": F.size("evidence"), "metric": first["metric"], "reference_value": first["reference_value"], "target_value": first["target_value"]}).drop("evidence")


@query(f"{_CHAIN} {pair_sql.ranked('zone')}", pair_sql.ISSUE_DOUBLES)
def e21_braking_issues(spark, sf_dir):
    return _flat(rules.braking_issues(_analysis(spark, sf_dir).zone_deltas))


@query(f"{_CHAIN} {pair_sql.ranked('entry')}", pair_sql.ISSUE_DOUBLES)
def e22_entry_issues(spark, sf_dir):
    return _flat(rules.entry_issues(_analysis(spark, sf_dir).entry_deltas))


@query(f"{_CHAIN} {pair_sql.ranked('exit')}", pair_sql.ISSUE_DOUBLES)
def e23_exit_issues(spark, sf_dir):
    return _flat(rules.exit_issues(_analysis(spark, sf_dir).exit_deltas))


@query(f"{_CHAIN} SELECT * FROM corner_issues", pair_sql.CORNER_ISSUE_DOUBLES)
def e24_corner_issues(spark, sf_dir):
    return _flat(_analysis(spark, sf_dir).corner_issues)


@query(f"{_CHAIN} SELECT * FROM issues ANTI JOIN corner_issues USING (session_id, ref_lap, target_lap, source, code, center_progress)", pair_sql.ISSUE_DOUBLES)
def e24_stray_issues(spark, sf_dir):
    analysis = _analysis(spark, sf_dir)
    issues = analysis.issues
    return _flat(rules.stray_issues(analysis.corner_deltas, issues))


@query(f"{_CHAIN} SELECT * FROM advice", pair_sql.CORNER_ISSUE_DOUBLES)
def e25_advice(spark, sf_dir):
    return _flat(_analysis(spark, sf_dir).advice)


@query(f"{_CHAIN} SELECT * FROM plan", f"{pair_sql.CORNER_ISSUE_DOUBLES} impact_score")
def e26_coaching_plan(spark, sf_dir):
    return _flat(_analysis(spark, sf_dir).plan)


@query(f"{_CHAIN} {pair_sql.REPORT}", "total_time_lost_seconds total_time_gained_seconds net_delta_seconds")
def e28_lap_pair_report(spark, sf_dir):
    return _analysis(spark, sf_dir).report
