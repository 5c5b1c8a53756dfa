"""Queries on laps, sectors and snapshots, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions import scalars
from paddock.operators import events, laps
from paddock.plans.session_queries import query
from paddock.plans.views import LAPS_SQL, SECTORS_SQL
from paddock.plans.views import laps as laps_view
from paddock.plans.views import sectors as sectors_view

_TABLES = f"WITH laps AS MATERIALIZED ({LAPS_SQL}), sectors AS MATERIALIZED ({SECTORS_SQL})"
_BEST_SECTORS = (
    "SELECT session_id, sector_number, CAST(min(sector_time_ms) AS BIGINT) AS best_sector_time_ms, arg_min(lap_number, CAST(sector_time_ms "
    "AS BIGINT) * 100000 + lap_number) AS best_lap_number FROM sectors WHERE sector_time_ms > 0 GROUP BY session_id, sector_number"
)
_HISTORY = (
    "SELECT *, CASE WHEN best_lap_time_ms IS NOT NULL AND theoretical_best_ms IS NOT NULL THEN CAST(greatest(0, best_lap_time_ms - theoretical_best_ms) "
    "AS BIGINT) END AS potential_gain_ms FROM "
    "(SELECT session_id, count(*) AS lap_count, min(lap_time_ms) FILTER (lap_time_ms > 0) AS best_lap_time_ms, arg_min(lap_number, CAST(lap_time_ms "
    "AS BIGINT) * 100000 + lap_number) FILTER (lap_time_ms > 0) AS best_lap_number, "
    "avg(lap_time_ms) FILTER (lap_time_ms > 0) AS average_lap_time_ms, stddev_pop(lap_time_ms) FILTER (lap_time_ms > 0) AS stddev_lap_time_ms FROM laps GROUP BY session_id) LEFT JOIN "
    f"(SELECT session_id, CAST(sum(best_sector_time_ms) AS BIGINT) AS theoretical_best_ms, count(*) AS sector_count FROM ({_BEST_SECTORS}) GROUP BY session_id) USING (session_id)"
)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return laps_view(spark, sf_dir), sectors_view(spark, sf_dir)


@query(f"{_TABLES} {_HISTORY}".replace("WITH", "SELECT * REPLACE (round(average_lap_time_ms + 1e-9, 6) AS average_lap_time_ms, round(stddev_lap_time_ms + 1e-9, 6) AS stddev_lap_time_ms) FROM (WITH", 1) + ")")
def d8_session_history(spark, sf_dir):
    return laps.history(*_tables(spark, sf_dir))


@query(f"{_TABLES} {_BEST_SECTORS}")
def d8_best_sectors(spark, sf_dir):
    return laps.best_sectors(sectors_view(spark, sf_dir))


@query(
    f"{_TABLES} SELECT l.session_id, l.lap_number, lap_time_ms, coalesce(n, 0) AS sector_count, coalesce(l.lap_number = best_lap_number, false) "
    "AS is_session_best, s.first_sector, s.last_ms "
    "FROM laps l LEFT JOIN (SELECT session_id, lap_number, CAST(count(*) AS INTEGER) AS n, min(sector_number) AS first_sector, arg_max(sector_time_ms, "
    "sector_number) AS last_ms FROM sectors GROUP BY 1, 2) s "
    f"ON l.session_id = s.session_id AND l.lap_number = s.lap_number LEFT JOIN ({_HISTORY}) h ON l.session_id = h.session_id"
)
def d9_lap_list(spark, sf_dir):
    listed = laps.lap_list(*_tables(spark, sf_dir))
    at = lambda i, f: F.try_element_at("sectors", F.lit(i))[f]
    return listed.select("session_id", "lap_number", "lap_time_ms", F.size("sectors").alias("sector_count"), "is_session_best", at(1, "sector_number").alias("first_sector"), at(-1, "sector_time_ms").alias("last_ms"))


_PACE = (
    "SELECT session_id, count(*) AS timed_laps, arg_min(lap_number, CAST(lap_time_ms AS BIGINT) * 100000 + lap_number) AS best_lap_number, "
    "avg(lap_time_ms) AS mean_ms, CASE WHEN count(*) >= 3 THEN stddev_pop(lap_time_ms) END AS spread_ms, "
    "max(change) FILTER (last_one) AS last_change_ms FROM (SELECT *, lap_time_ms - lag(lap_time_ms) OVER w AS change, lead(lap_number) OVER w IS NULL AS last_one "
    f"FROM ({LAPS_SQL}) WHERE lap_time_ms > 0 WINDOW w AS (PARTITION BY session_id ORDER BY lap_number)) GROUP BY session_id"
)


@query(_PACE, "mean_ms spread_ms")
def d11_pace(spark, sf_dir):
    return laps.pace(laps_view(spark, sf_dir))


#: Each lap and the next
_PAIRS = "SELECT session_id, lap_number AS ref_lap, lap_number + 1 AS target_lap FROM laps"


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("session_id", F.col("lap_number").alias("ref_lap"), (F.col("lap_number") + 1).alias("target_lap"))


_DELTAS = (
    "SELECT p.session_id, p.ref_lap, p.target_lap, r.sector_number, r.sector_time_ms AS ref_ms, t.sector_time_ms AS target_ms, t.sector_time_ms - r.sector_time_ms AS delta_ms FROM pairs p "
    "JOIN sectors r ON r.session_id = p.session_id AND r.lap_number = p.ref_lap AND r.sector_time_ms > 0 "
    "JOIN sectors t ON t.session_id = p.session_id AND t.lap_number = p.target_lap AND t.sector_number = r.sector_number AND t.sector_time_ms > 0"
)
_PAIRED = f"{_TABLES}, pairs AS ({_PAIRS}), deltas AS MATERIALIZED ({_DELTAS}), counts AS (SELECT session_id, lap_number, count(*) AS n FROM sectors WHERE sector_time_ms > 0 GROUP BY 1, 2)"
_COMPARE = (
    "SELECT p.session_id, p.ref_lap, p.target_lap, r.lap_time_ms AS ref_time_ms, t.lap_time_ms AS target_time_ms, t.lap_time_ms - r.lap_time_ms "
    "AS total_delta_ms, coalesce(c, 0) AS common_sectors, coalesce(lost, 0) AS lost_ms, coalesce(gained, 0) AS gained_ms, "
    "biggest_loss_sector, biggest_gain_sector, coalesce(c, 0) > 0 AND coalesce(c, 0) = coalesce(rc.n, 0) AND coalesce(c, 0) = coalesce(tc.n, 0) "
    "AS is_complete FROM pairs p JOIN laps r ON r.session_id = p.session_id AND r.lap_number = p.ref_lap "
    "JOIN laps t ON t.session_id = p.session_id AND t.lap_number = p.target_lap LEFT "
    "JOIN counts rc ON rc.session_id = p.session_id AND rc.lap_number = p.ref_lap LEFT "
    "JOIN counts tc ON tc.session_id = p.session_id AND tc.lap_number = p.target_lap "
    "LEFT JOIN (SELECT session_id, ref_lap, target_lap, count(*) AS c, CAST(sum(greatest(delta_ms, 0)) AS BIGINT) AS lost, CAST(sum(greatest(-delta_ms, "
    "0)) AS BIGINT) AS gained, arg_min(sector_number, -delta_ms * 100 + sector_number) FILTER (delta_ms > 0) AS biggest_loss_sector, "
    "arg_min(sector_number, delta_ms * 100 + sector_number) FILTER (delta_ms < 0) AS biggest_gain_sector FROM deltas "
    "GROUP BY 1, 2, 3) d ON d.session_id = p.session_id AND d.ref_lap = p.ref_lap AND d.target_lap = p.target_lap"
)


@query(f"{_PAIRED} {_COMPARE}")
def e3_lap_comparison(spark, sf_dir):
    lap, sector = _tables(spark, sf_dir)
    return laps.compare(_pairs(lap), lap, sector)


@query(
    f"{_TABLES}, pairs AS (SELECT l.session_id, best_lap_number AS ref_lap, lap_number AS target_lap FROM laps l "
    f"JOIN ({_HISTORY}) h ON l.session_id = h.session_id WHERE lap_time_ms > 0 AND lap_number <> best_lap_number), "
    f"deltas AS MATERIALIZED ({_DELTAS}), counts AS (SELECT session_id, lap_number, count(*) AS n FROM sectors WHERE sector_time_ms > 0 GROUP BY 1, 2) {_COMPARE}"
)
def e4_compare_to_best(spark, sf_dir):
    lap, sector = _tables(spark, sf_dir)
    return laps.compare(laps.pairs_with_best(lap, sector), lap, sector)


_DIAGNOSE = (
    "SELECT d.session_id, d.ref_lap, d.target_lap, sector_number, delta_ms, kind, row_number() OVER (PARTITION BY d.session_id, d.ref_lap, d.target_lap, "
    "kind ORDER BY abs(delta_ms) DESC, sector_number) AS rank, "
    "CASE WHEN kind = 'lost' THEN delta_ms * 1e0 / nullif(sum(greatest(delta_ms, 0)) OVER w, 0) END AS loss_share, "
    "t.lap_time_ms - r.lap_time_ms - CAST(sum(delta_ms) OVER w AS BIGINT) AS unexplained_ms "
    "FROM (SELECT *, CASE WHEN delta_ms > 0 THEN 'lost' WHEN delta_ms < 0 THEN 'gained' ELSE 'neutral' END AS kind FROM deltas) d "
    "JOIN laps r ON r.session_id = d.session_id AND r.lap_number = d.ref_lap JOIN laps t ON t.session_id = d.session_id AND t.lap_number = d.target_lap "
    "WINDOW w AS (PARTITION BY d.session_id, d.ref_lap, d.target_lap)"
)


@query(f"SELECT * REPLACE (round(loss_share + 1e-9, 6) AS loss_share) FROM ({_PAIRED} {_DIAGNOSE})")
def e5_sector_diagnosis(spark, sf_dir):
    lap, sector = _tables(spark, sf_dir)
    return laps.diagnose(_pairs(lap), lap, sector)


_ADVICE = (
    f"{_PAIRED}, diag AS MATERIALIZED ({_DIAGNOSE}), comp AS ({_COMPARE}), advice AS ("
    "SELECT session_id, ref_lap, target_lap, 1 AS rule, 'data_quality' AS code, 'HIGH' AS priority, NULL AS sector_number, NULL AS delta_ms FROM comp "
    "WHERE NOT is_complete OR total_delta_ms <> lost_ms - gained_ms "
    "UNION ALL SELECT session_id, ref_lap, target_lap, 2, 'primary_sector', CASE WHEN loss_share >= 0.6e0 THEN 'HIGH' "
    "WHEN loss_share >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END, sector_number, delta_ms FROM diag WHERE kind = 'lost' AND rank = 1 "
    "UNION ALL SELECT session_id, ref_lap, target_lap, 3, 'secondary_sector', 'MEDIUM', sector_number, delta_ms FROM diag WHERE kind = 'lost' AND rank = 2 "
    "UNION ALL SELECT session_id, ref_lap, target_lap, 4, 'balanced_improvement', 'LOW', sector_number, delta_ms FROM diag d "
    "WHERE kind = 'lost' AND rank = 1 AND loss_share < 0.6e0 AND EXISTS (SELECT 1 FROM diag x "
    "WHERE x.session_id = d.session_id AND x.ref_lap = d.ref_lap AND x.target_lap = d.target_lap AND x.kind = 'lost' AND x.rank = 2) "
    "UNION ALL SELECT session_id, ref_lap, target_lap, 5, 'consolidate_gain', 'LOW', sector_number, delta_ms FROM diag WHERE kind = 'gained' AND rank = 1) "
    "SELECT session_id, ref_lap, target_lap, code, priority, sector_number, delta_ms, row_number() OVER (PARTITION BY session_id, ref_lap, target_lap "
    "ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, rule) AS rank FROM advice"
)


@query(_ADVICE)
def e6_sector_advice(spark, sf_dir):
    lap, sector = _tables(spark, sf_dir)
    return laps.recommend(_pairs(lap), lap, sector)


@query(
    "SELECT session_id, lap_number, concat(CAST(lap_time_ms // 60000 AS VARCHAR), ':', lpad(CAST(lap_time_ms % 60000 // 1000 AS VARCHAR), 2, '0'), '.', "
    "lpad(CAST(lap_time_ms % 1000 AS VARCHAR), 3, '0')) AS lap_time, "
    "concat(CASE WHEN lap_time_ms < 75000 THEN '-' ELSE '+' END, CAST(abs(lap_time_ms - 75000) // 1000 AS VARCHAR), '.', "
    f"lpad(CAST(abs(lap_time_ms - 75000) % 1000 AS VARCHAR), 3, '0'), ' s') AS to_target FROM ({LAPS_SQL})"
)
def b16_lap_time_text(spark, sf_dir):
    return laps_view(spark, sf_dir).select("session_id", "lap_number", scalars.lap_time_text(F.col("lap_time_ms")).alias("lap_time"), scalars.signed_delta_text(F.col("lap_time_ms") - 75000).alias("to_target"))


#: Snapshots derived from events: ordered counters of each user as a source
_SNAPSHOT = {
    "packet_id": "CASE WHEN event_id % 41 = 0 THEN 0 WHEN event_id % 5 = 0 THEN (n - 1) * 10 ELSE n * 10 END", "status_code": "CASE WHEN event_id % 13 = 0 THEN 1 WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 29 = 0 THEN 9 ELSE 2 END",
    "session_code": "(n {div} 40) % 3", "car_model": "concat('car', CAST((n {div} 30) % 2 AS {string}))", "track": "'ring'", "completed_laps": "(n % 30) {div} 6", "current_sector_index": "(n % 6) {div} 2",
    "last_time_ms": "60000 + event_id * 7 % 5000", "best_time_ms": "61000 + event_id * 11 % 3000 - 500", "last_sector_time_ms": "20000 + event_id * 3 % 900", "position": "1 + event_id % 20",
    "seen_at_seconds": "n * 0.8e0", "progress": "(n % 6) / 5e0 * 0.98e0", "elapsed_seconds": "(n % 6) * 15e0 + event_id % 3",
    "speed_kmh": "100e0 + event_id % 50", "throttle": "(event_id % 11) / 10e0", "brake": "(event_id % 7) / 10e0", "steering_angle_deg": "event_id % 31 - 15e0",
}
_STATUS = "CASE status_code WHEN 1 THEN 'REPLAY' WHEN 2 THEN 'LIVE' WHEN 3 THEN 'PAUSE' ELSE 'OFF' END"
_TYPE = "CASE session_code WHEN 0 THEN 'practice' WHEN 1 THEN 'qualifying' WHEN 2 THEN 'race' ELSE 'test' END"
_RAW = ", ".join(f"{e.format(div='//', string='VARCHAR')} AS {c}" for c, e in _SNAPSHOT.items())
SNAPSHOT_SQL = (
    f"SELECT *, {_STATUS} AS status, {_TYPE} AS session_type FROM (SELECT user_id AS source_id, n AS arrival, {_RAW} "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"
)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("n"))
    raw = numbered.select(F.col("user_id").alias("source_id"), F.col("n").alias("arrival"), *(F.expr(e.format(div="div", string="STRING")).alias(c) for c, e in _SNAPSHOT.items()))
    return raw.withColumns({"status": scalars.status_name(F.col("status_code")), "session_type": scalars.session_type_name(F.col("session_code"))})


_W = "PARTITION BY source_id ORDER BY arrival"
_SESSIONS_SQL = (
    "SELECT *, CAST(sum(CASE WHEN is_new_session THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY arrival) AS BIGINT) AS session_number "
    "FROM (SELECT *, coalesce(lag(arrival) OVER w IS NULL OR car_model <> lag(car_model) OVER w OR track <> lag(track) OVER w "
    "OR session_type <> lag(session_type) OVER w OR completed_laps < lag(completed_laps) OVER w OR packet_id < lag(packet_id) OVER w OR (status = 'LIVE' "
    "AND lag(status) OVER w IN ('OFF', 'REPLAY')), false) AS is_new_session "
    f"FROM ({SNAPSHOT_SQL}) WINDOW w AS ({_W}))"
)
_FLAGS_SQL = (
    "SELECT *, NOT is_new_session AND coalesce(completed_laps > lag(completed_laps) OVER w, false) AS lap_completed, NOT is_new_session "
    "AND coalesce(current_sector_index <> lag(current_sector_index) OVER w, false) AS sector_changed, "
    f"lag(current_sector_index) OVER w AS sector_before FROM ({_SESSIONS_SQL}) WINDOW w AS ({_W})"
)


@query(f"SELECT source_id, arrival, status, session_type, is_new_session, session_number FROM ({_SESSIONS_SQL})")
def c1_sessionize(spark, sf_dir):
    return events.sessionize(snapshots(spark, sf_dir)).select("source_id", "arrival", "status", "session_type", "is_new_session", "session_number")


def _flags(spark, sf_dir):
    return events.progress_flags(events.sessionize(snapshots(spark, sf_dir)))


@query(f"SELECT source_id, arrival, lap_completed, sector_changed FROM ({_FLAGS_SQL})")
def c2_progress_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("source_id", "arrival", "lap_completed", "sector_changed")


@query(
    "SELECT source_id, session_number, arrival, completed_laps AS lap_number, greatest(0, last_time_ms) AS lap_time_ms, greatest(0, best_time_ms) "
    "AS best_lap_time_ms, last_time_ms > 0 AND best_time_ms > 0 AND last_time_ms <= best_time_ms AS is_best, position "
    f"FROM ({_FLAGS_SQL}) WHERE lap_completed"
)
def c3_lap_events(spark, sf_dir):
    return events.lap_events(_flags(spark, sf_dir))


@query(
    "SELECT source_id, session_number, arrival, CASE WHEN lap_completed THEN greatest(1, completed_laps) "
    "ELSE completed_laps + 1 END AS lap_number, greatest(0, sector_before) AS sector_index, greatest(0, sector_before) + 1 AS sector_number, "
    f"greatest(0, last_sector_time_ms) AS sector_time_ms, position FROM ({_FLAGS_SQL}) WHERE sector_changed"
)
def c4_sector_events(spark, sf_dir):
    return events.sector_events(_flags(spark, sf_dir))


_SINCE = "last_value(CASE WHEN {0} THEN seen_at_seconds END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY arrival ROWS UNBOUNDED PRECEDING)"
_CHANGED = f"(SELECT *, coalesce(packet_id <> lag(packet_id) OVER ({_W}), true) AS changed FROM ({SNAPSHOT_SQL}))"


@query(
    f"SELECT source_id, arrival, round(seen_at_seconds - {_SINCE.format('changed')} + 1e-9, 6) AS unchanged_seconds, "
    f"seen_at_seconds - {_SINCE.format('changed')} >= 0.5e0 AS is_stale FROM {_CHANGED}"
)
def c8_stale_sources(spark, sf_dir):
    return events.stale(snapshots(spark, sf_dir), seconds=0.5).select("source_id", "arrival", "unchanged_seconds", "is_stale")


_STRETCHES = (
    "SELECT *, sum(CASE WHEN coalesce(completed_laps <> before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, session_number "
    "ORDER BY arrival) AS stretch FROM (SELECT *, lag(completed_laps) OVER (PARTITION BY source_id, session_number ORDER BY arrival) AS before "
    f"FROM ({_SESSIONS_SQL}))"
)
_CHANNELS = "progress, elapsed_seconds, speed_kmh, throttle, brake, steering_angle_deg"
_SAMPLE = "{'i': arrival, " + ", ".join(f"'{c}': {c}" for c in _CHANNELS.split(", ")) + "}"
_ACCEPT = (
    "list_reduce(list_transform(list(s ORDER BY arrival), lambda x: {'m': [x]}), lambda kept, x: CASE "
    "WHEN x.m[1].elapsed_seconds < kept.m[-1].elapsed_seconds OR x.m[1].progress < kept.m[-1].progress THEN kept "
    "WHEN x.m[1].progress = kept.m[-1].progress THEN {'m': list_concat(kept.m[:-2], x.m)} ELSE {'m': list_concat(kept.m, x.m)} END).m"
)
_LAP_TRACES = (
    "SELECT source_id, session_number, laps + 1 AS lap_number, lap_time_ms, unnest(range(len(kept))) AS sample_index, unnest(kept) AS s "
    "FROM (SELECT *, lag(laps) OVER w AS laps_before, lead(laps) OVER w AS laps_after, lead(first_time) OVER w AS lap_time_ms "
    "FROM (SELECT source_id, session_number, stretch, arg_min(completed_laps, arrival) AS laps, arg_min(progress, arrival) AS p, arg_min(elapsed_seconds, "
    f"arrival) AS e, arg_min(last_time_ms, arrival) AS first_time, {_ACCEPT} AS kept "
    f"FROM (SELECT *, {_SAMPLE} AS s FROM ({_STRETCHES})) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY source_id, session_number ORDER BY stretch)) "
    "WHERE (coalesce(laps_before < laps, false) OR (p <= 0.05e0 AND e <= 5e0)) AND laps_after > laps AND lap_time_ms > 0 AND len(kept) >= 3 "
    "AND kept[1].progress <= 0.05e0 AND kept[-1].progress >= 0.9e0"
)


@query(
    "SELECT source_id, session_number, lap_number, lap_time_ms, CAST(sample_index AS INTEGER) AS sample_index, "
    f"{', '.join(f's.{c} AS {c}' for c in _CHANNELS.split(', '))} FROM ({_LAP_TRACES})",
    _CHANNELS.replace(",", ""),
)
def c5_lap_traces(spark, sf_dir):
    """Lap traces with the order-dependent acceptance of samples."""
    return events.lap_traces(events.sessionize(snapshots(spark, sf_dir)), end=0.9)
