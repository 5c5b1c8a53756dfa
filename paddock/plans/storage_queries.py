"""Queries on sources, catalog, setups, learning, parity and streams, with SQL for each where it expresses them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.storage import shared_folder, stored
from paddock.operators import catalog, learn, parity, quality, setups, traces
from paddock.plans import lap_queries
from paddock.plans.session_queries import AUDIT_SQL, ONCE_SQL, UNROUNDED, VALID_SQL, _once, _valid, query
from paddock.plans.views import CHANNELS, LAPS_SQL, TELEMETRY_SQL, TRACE_SQL, laps, telemetry, trace
from paddock.sources import frames, kafka
from paddock.sources import traces as trace_files
from paddock.streaming import live, stages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CHANNELS = [c for c in CHANNELS if c.startswith(("vehicle_", "environment_", "fl_"))]


@query(f"SELECT session_id, sample_index, {', '.join(_CHANNELS)}, vehicle_rpm, vehicle_gear FROM ({TELEMETRY_SQL})", " ".join(_CHANNELS))
def a3_json_round_trip(spark, sf_dir):
    """Frames written as JSON lines, parsed and flattened again."""
    nested = frames.unflatten(telemetry(spark, sf_dir).drop("event_id"))
    lines = nested.select(F.to_json(F.struct("timestamp", "session_id", "sample_index", "elapsed_seconds", "car_id", "track_id", "vehicle", "environment", "wheels")).alias("value"), F.lit("memory").alias("source_file"))
    return frames.flatten(frames.parse_frames(lines)[0]).select("session_id", "sample_index", *_CHANNELS, "vehicle_rpm", "vehicle_gear")


def _metadata(df: DataFrame) -> DataFrame:
    """Metadata of the sessions: every seventh claims one frame too many, every eleventh another car."""
    number = F.substring("session_id", 2, 20).cast("long")
    counts = df.groupBy("session_id").agg(F.first("car_id").alias("car_id"), F.first("track_id").alias("track_id"), F.first("setup_id").alias("setup_id"), F.min("timestamp").alias("started_at"), F.count(F.lit(1)).alias("n"))
    return counts.select(
        "session_id", F.when(number % 11 == 0, "another").otherwise(F.col("car_id")).alias("car_id"), "track_id", "setup_id", F.lit("events").alias("source"), F.lit("test").alias("session_type"), "started_at",
        (F.col("n") + F.when(number % 7 == 0, 1).otherwise(0)).alias("sample_count"),
    )


@query(
    "SELECT session_id, CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 11 = 0 THEN 'identity_mismatch' ELSE 'sample_count_mismatch' END AS problem, count(*) AS samples "
    f"FROM ({ONCE_SQL}) WHERE CAST(substr(session_id, 2) AS BIGINT) % 11 = 0 OR CAST(substr(session_id, 2) AS BIGINT) % 7 = 0 GROUP BY session_id"
)
def a5_rejected_sessions(spark, sf_dir):
    rows = _once(spark, sf_dir).drop("setup_id", "session_type", "telemetry_source", "event_id")
    return frames.bronze(frames.unflatten(rows), _metadata(_once(spark, sf_dir)))[1].select("session_id", "problem", "samples")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(
    f"SELECT {_LINE} FROM (SELECT {_LINE}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_suppkey % 2 DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1"
)
def a12_keyed_upsert(spark, sf_dir):
    """Lines of odd suppliers are new, the others already stored."""
    rows = _table(spark, sf_dir, "lineitem").select(*_LINE.split(", "))
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return catalog.upsert(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"), ("l_orderkey", "l_linenumber"), order)


@query(
    "SELECT p_partkey AS part_key, CAST(p_partkey AS VARCHAR) AS name FROM (SELECT DISTINCT l_partkey AS p_partkey FROM lineitem) "
    "WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)"
)
def a13_missing_dimension(spark, sf_dir):
    known = _table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("part_key"))
    return catalog.missing_dimension(_table(spark, sf_dir, "lineitem"), "l_partkey", known, "part_key")


@query("SELECT 'events' AS kind, count(*) AS rows FROM events UNION ALL SELECT 'laps', count(*) FROM orders UNION ALL SELECT 'sectors', count(*) FROM lineitem")
def a14_load_counts(spark, sf_dir):
    return catalog.load_counts({"events": _table(spark, sf_dir, "events"), "laps": _table(spark, sf_dir, "orders"), "sectors": _table(spark, sf_dir, "lineitem")})


_PRINTED = {"car_id": "string", "fl_load_n": "double", "sample_index": "bigint", "timestamp": "timestamp", "vehicle_brake": "double", "vehicle_gear": "bigint", "vehicle_speed_kmh": "double", "vehicle_steering_angle_deg": "double", "vehicle_throttle": "double"}
_TEXTS = [f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')" if k == "timestamp" else f"CAST({c} AS VARCHAR)" for c, k in _PRINTED.items()]
_ROW_HASH = "CAST('0x' || substr(md5(concat(" + ", ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in _TEXTS) + ")), 1, 15) AS BIGINT)"


@query(
    f"SELECT session_id, count(*) AS rows, sha256(concat_ws('|', '{';'.join(f'{c}:{k}' for c, k in _PRINTED.items())}', count(*), sum(h), min(h), max(h))) AS fingerprint "
    f"FROM (SELECT session_id, {_ROW_HASH} AS h FROM ({TELEMETRY_SQL})) GROUP BY session_id"
)
def a16_fingerprints(spark, sf_dir):
    """Each session's content hash over text, whole numbers, doubles, times and nulls."""
    return parity.fingerprint(telemetry(spark, sf_dir).select("session_id", *_PRINTED), ("session_id",))


@query(f"SELECT session_id FROM ({ONCE_SQL}) GROUP BY session_id HAVING max(CASE WHEN event_id % 89 = 3 THEN 1 ELSE 0 END) = 1")
def a17_changed_sessions(spark, sf_dir):
    """Sessions whose content isn't that of the manifest: some frames differ in one channel."""
    now = _once(spark, sf_dir)
    before = now.withColumn("vehicle_brake", F.when(F.col("event_id") % 89 == 3, 2.0).otherwise(F.col("vehicle_brake")))
    return parity.changed(parity.fingerprint(now, ("session_id",)), parity.fingerprint(before, ("session_id",)))


@query(f"SELECT session_id, lap_number, CAST(sample_index AS INTEGER) AS sample_index, progress, elapsed_seconds, speed_kmh FROM ({TRACE_SQL})", "progress elapsed_seconds speed_kmh")
def a18_lap_exchange(spark, sf_dir):
    """Laps exported as JSON documents and imported again."""
    documents = trace_files.export_exchange(trace(spark, sf_dir))
    named = documents.select(F.concat_ws("/", "session_id", "lap_number").alias("name"), F.col("document").alias("value"))
    part = F.split("name", "/")
    return trace_files.parse_exchange(named).select(part[0].alias("session_id"), part[1].cast("int").alias("lap_number"), "sample_index", "progress", "elapsed_seconds", "speed_kmh")


@query(
    "SELECT session_id, lap_number, sample_index, d / max(d) OVER (PARTITION BY session_id) AS progress, "
    "sum(coalesce((d - pd) / ((speed_kmh + ps) / 2 / 3.6e0), 0e0)) OVER (PARTITION BY session_id, lap_number "
    "ORDER BY sample_index ROWS UNBOUNDED PRECEDING) AS elapsed_seconds, throttle "
    f"FROM (SELECT *, lag(d) OVER w AS pd, lag(speed_kmh) OVER w AS ps FROM (SELECT *, progress * 4000e0 + 10 AS d FROM ({TRACE_SQL})) "
    "WINDOW w AS (PARTITION BY session_id, lap_number ORDER BY sample_index))",
    "progress elapsed_seconds throttle",
)
def a19_distance_import(spark, sf_dir):
    t = trace(spark, sf_dir)
    measured = t.select("session_id", "lap_number", "sample_index", (F.col("progress") * 4000 + 10).alias("lap_distance_m"), F.lit(None).cast("double").alias("elapsed_seconds"), "speed_kmh", (F.col("throttle") * 100).alias("throttle"), (F.col("brake") * 100).alias("brake"))
    return trace_files.normalize_distance(measured, "lap_number", ("session_id",)).select("session_id", "lap_number", "sample_index", "progress", "elapsed_seconds", "throttle")


_ERROR = "CASE WHEN event_id % 19 = 0 THEN 'invalid_json' WHEN event_id % 23 = 0 THEN 'unsupported_schema' WHEN event_id % 29 = 0 THEN 'invalid_metadata' END"


DECODED_SQL = (
    f"SELECT session_id, sample_index, {_ERROR} AS decode_error, coalesce({_ERROR} IS NULL AND is_valid AND event_id % 31 <> 0, false) AS is_valid, "
    f"event_id % 31 <> 0 AS has_time FROM ({AUDIT_SQL}) WHERE event_id % 19 <> 0 "
    f"UNION ALL SELECT NULL, NULL, 'invalid_json', false, false FROM ({ONCE_SQL}) WHERE event_id % 19 = 0"
)


def broker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker records of all frames, some broken, of another version, with a wrong key or with a time that can't be read."""
    sent = kafka.encode(frames.unflatten(_once(spark, sf_dir)), keep=("event_id",))
    text = F.col("value").cast("string")
    timed = F.when(F.col("event_id") % 31 == 0, F.regexp_replace(text, r'"timestamp":"[^"]*"', '"timestamp":"not a time"')).otherwise(text)
    value = F.when(F.col("event_id") % 19 == 0, F.substring(text, 1, 40)).when(F.col("event_id") % 23 == 0, F.regexp_replace(timed, '"schema_version":1', '"schema_version":99')).otherwise(timed)
    key = F.when(F.col("event_id") % 29 == 0, F.lit("wrong").cast("binary")).otherwise(F.col("key"))
    return sent.select(
        key.alias("key"), value.cast("binary").alias("value"), F.lit("telemetry").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp")
    )


def decoded(rows: DataFrame) -> DataFrame:
    known = lambda c: F.when(F.col("decode_error").isNull() | (F.col("decode_error") != "invalid_json"), F.col(c))
    return rows.select(known("session_id").alias("session_id"), known("sample_index").alias("sample_index"), "decode_error", "is_valid", F.coalesce(known("timestamp").isNotNull(), F.lit(False)).alias("has_time"))


@query(DECODED_SQL)
def b7_kafka_decode(spark, sf_dir):
    """The records decoded and flagged as a batch."""
    return decoded(kafka.audit(kafka.decode(broker_records(spark, sf_dir))))


_SESSIONS = f"SELECT session_id AS id, min(occurred_at) AS started_at, count(*) AS n FROM ({LAPS_SQL}) GROUP BY session_id"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laps(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(F.min("occurred_at").alias("started_at"))


@query(
    f"SELECT id, started_at, n AS lap_count, coalesce(t, 0) AS trace_count FROM (SELECT * FROM ({_SESSIONS}) ORDER BY started_at DESC, id DESC LIMIT 20) "
    f"LEFT JOIN (SELECT session_id, count(*) AS t FROM ({LAPS_SQL}) WHERE lap_key % 3 = 0 GROUP BY 1) ON id = session_id"
)
def d10_recent_sessions(spark, sf_dir):
    lap = laps(spark, sf_dir)
    return catalog.recent_sessions(_sessions(spark, sf_dir), lap, lap.where("lap_key % 3 = 0"))


@query(
    "SELECT source, arg_max(id, (started_at, id)) AS id, max(started_at) AS started_at FROM (SELECT *, CASE "
    f"WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM ({_SESSIONS})) GROUP BY source"
)
def e30_latest_by_source(spark, sf_dir):
    rows = _sessions(spark, sf_dir).withColumn("source", F.when(F.substring("id", 2, 20).cast("long") % 2 == 0, "even").otherwise("odd"))
    return catalog.latest(rows, by=("source",))


#: Setups derived from parts
_SETUP = {
    "front_pressure": "18e0 + p_partkey % 14", "rear_pressure": "CASE WHEN p_partkey % 5 <> 0 THEN 18e0 + (p_partkey * 7) % 14 END", "brake_bias": "0.4e0 + (p_partkey * 3 % 40) / 100e0", "wing": "CASE WHEN p_partkey % 6 = 0 THEN p_size * 1e0 END",
}
SETUPS_SQL = " UNION ALL ".join(f"SELECT p_partkey AS setup_id, p_brand AS car_id, '{n}' AS parameter, {e} AS value FROM part WHERE ({e}) IS NOT NULL" for n, e in _SETUP.items())
_RANGES = {"front_pressure": (20.0, 30.0), "rear_pressure": (20.0, 30.0), "brake_bias": (0.5, 0.75)}


def _setup_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.map_filter(F.create_map(*(x for n, e in _SETUP.items() for x in (F.lit(n), F.expr(e)))), lambda _, v: v.isNotNull())
    return setups.parameters(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("setup_id"), F.col("p_brand").alias("car_id"), values.alias("values")))


@query(
    "SELECT setup_id, car_id, parameter, value, CASE WHEN parameter = 'wing' THEN 'unknown_parameter' ELSE 'out_of_range' END AS problem "
    f"FROM ({SETUPS_SQL}) WHERE parameter = 'wing' OR (parameter = 'brake_bias' AND value NOT BETWEEN 0.5e0 AND 0.75e0) OR (parameter LIKE '%pressure' "
    "AND value NOT BETWEEN 20 AND 30)",
    "value",
)
def b14_setup_violations(spark, sf_dir):
    values = _setup_values(spark, sf_dir)
    bounds = F.explode(F.array(*(F.struct(F.lit(n).alias("parameter"), F.lit(a).alias("minimum"), F.lit(b).alias("maximum")) for n, (a, b) in _RANGES.items())))
    ranges = values.select("car_id").distinct().select("car_id", bounds.alias("r")).select("car_id", "r.*")
    return setups.setup_violations(values, ranges)


_SETUP_PAIRS = "SELECT p_partkey AS previous_setup, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS new_setup FROM part"


@query(
    "SELECT previous_setup, new_setup, a.car_id, a.parameter, a.value AS previous_value, b.value AS new_value, b.value - a.value AS delta "
    f"FROM ({_SETUP_PAIRS}) JOIN ({SETUPS_SQL}) a ON a.setup_id = previous_setup "
    f"JOIN ({SETUPS_SQL}) b ON b.setup_id = new_setup AND a.parameter = b.parameter AND a.car_id = b.car_id WHERE a.value <> b.value",
    "previous_value new_value delta",
)
def e1_setup_diff(spark, sf_dir):
    _table(spark, sf_dir, "part").select("p_partkey", "p_brand").createOrReplaceTempView("paddock_part")
    return setups.setup_diff(_setup_values(spark, sf_dir), spark.sql(_SETUP_PAIRS.replace("FROM part", "FROM paddock_part")).where("new_setup is not null"))


def _long_sql(name: str, area: str, wheel: bool, drop: str = "") -> str:
    keys = "session_id, wheel" if wheel else "session_id"
    numbers = f"SELECT {keys}, CAST(COLUMNS(* EXCLUDE ({keys}{drop})) AS DOUBLE) FROM ({UNROUNDED[name]})"
    return f"SELECT session_id, '{area}' AS area, {'wheel' if wheel else repr('all')} AS wheel, metric, value FROM ({numbers}) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE ({keys}))))"


_REPORTS = " UNION ALL ".join(
    (
        _long_sql("d4_tyre_report", "tyre", True), _long_sql("c13_first_last_windows", "brake", True), _long_sql("d5_brake_report", "brake", False, ", sample_count"),
        _long_sql("d6_suspension_report", "suspension", True), _long_sql("d7_dynamics_report", "dynamics", False, ", sample_count"),
    )
)


@query(
    f"WITH reports AS MATERIALIZED ({_REPORTS}), places AS (SELECT DISTINCT session_id, car_id, track_id, CAST(substr(session_id, 2) AS BIGINT) AS n FROM ({VALID_SQL})) "
    "SELECT b.session_id AS baseline_session, c.session_id AS candidate_session, x.area, x.wheel, x.metric, x.value AS baseline_value, y.value "
    "AS candidate_value, y.value - x.value AS delta "
    "FROM places b JOIN places c ON c.n = b.n + 15 AND c.car_id = b.car_id AND c.track_id = b.track_id JOIN reports x ON x.session_id = b.session_id "
    "JOIN reports y ON y.session_id = c.session_id AND y.area = x.area AND y.wheel = x.wheel AND y.metric = x.metric",
    "baseline_value candidate_value delta",
)
def e2_experiment_comparison(spark, sf_dir):
    """Session pairs on the same car and track."""
    valid = _valid(spark, sf_dir)
    ids = valid.select("session_id", F.substring("session_id", 2, 20).cast("long").alias("n")).distinct()
    pairs = ids.select(F.col("session_id").alias("baseline_session"), F.concat(F.lit("s"), F.col("n") + 15).alias("candidate_session"))
    return setups.compare_experiments(pairs, stored(valid, "valid"))


#: Sweeps derived from parts: one per brand, seeds by part
_SWEEP = {
    "parameter_value": "20e0 + p_size % 13 / 2e0", "seed": "p_partkey % 5", "front_pressure_psi": "22e0 + p_size % 13 / 2e0 + p_partkey % 3 / 10e0", "rear_pressure_psi": "24.5e0", "front_slip_angle_deg": "2.7e0 + abs(p_size % 13 / 2e0 - 3) * 0.08e0 + p_partkey % 11 / 1000e0",
    "rear_slip_angle_deg": "3e0 + p_partkey % 7 / 100e0",
}
SWEEP_SQL = "SELECT p_brand AS sweep_id, p_partkey AS point_id, " + ", ".join(f"{e} AS {n}" for n, e in _SWEEP.items()) + " FROM part"


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_brand").alias("sweep_id"), F.col("p_partkey").alias("point_id"), *(F.expr(e).alias(n) for n, e in _SWEEP.items()))


_SWEEP_FEATURES = "parameter_delta_from_baseline absolute_parameter_delta_from_baseline front_rear_pressure_psi_delta front_rear_slip_angle_deg_delta"


@query(
    "SELECT sweep_id, point_id, parameter_value - 23e0 AS parameter_delta_from_baseline, abs(parameter_value - 23e0) "
    "AS absolute_parameter_delta_from_baseline, front_pressure_psi - rear_pressure_psi AS front_rear_pressure_psi_delta, "
    f"front_slip_angle_deg - rear_slip_angle_deg AS front_rear_slip_angle_deg_delta FROM ({SWEEP_SQL})",
    _SWEEP_FEATURES,
)
def b15_sweep_features(spark, sf_dir):
    return setups.sweep_features(_sweep(spark, sf_dir), 23.0).select("sweep_id", "point_id", *_SWEEP_FEATURES.split())


@query(
    "SELECT sweep_id, count(*) AS rows, min(parameter_value) AS minimum_value, max(parameter_value) AS maximum_value, first(parameter_value "
    f"ORDER BY front_slip_angle_deg, parameter_value) AS minimum_slip_value, min(front_slip_angle_deg) AS minimum_slip FROM ({SWEEP_SQL}) GROUP BY sweep_id",
    "minimum_value maximum_value minimum_slip_value minimum_slip",
)
def d12_sweep_eda(spark, sf_dir):
    return setups.sweep_eda(_sweep(spark, sf_dir))


@query(
    " UNION ALL ".join(
        f"SELECT sweep_id, '{m}' AS metric, CASE WHEN min({m}) < max({m}) AND min(parameter_value) < max(parameter_value) THEN round(covar_pop(parameter_value, "
        f"{m}) / (stddev_pop(parameter_value) * stddev_pop({m})) + 1e-9, 6) END AS correlation FROM ({SWEEP_SQL}) GROUP BY sweep_id"
        for m in ("front_pressure_psi", "rear_pressure_psi", "front_slip_angle_deg", "rear_slip_angle_deg")
    )
)
def d12_sweep_correlations(spark, sf_dir):
    return setups.sweep_correlations(_sweep(spark, sf_dir).drop("point_id", "seed"))


_AXLES = [f"{a}_{m}" for m in setups.AXLE_METRICS for a in ("front", "rear")]


@query(
    "SELECT sweep_id, parameter_value, " + ", ".join(f"avg({k} * front_slip_angle_deg + rear_slip_angle_deg) FILTER (seed {'< 2' if a == 'front' else '>= 2'}) AS {a}_{m}" for k, m in enumerate(setups.AXLE_METRICS) for a in ("front", "rear"))
    + f" FROM ({SWEEP_SQL}) GROUP BY 1, 2",
    " ".join(_AXLES),
)
def d15_sweep_rollup(spark, sf_dir):
    """Seeds stand in for wheels."""
    wheel = F.element_at(F.array(*map(F.lit, ("FL", "FR", "RL", "RR", "RR"))), (F.col("seed") + 1).cast("int"))
    metrics = {m: F.lit(k) * F.col("front_slip_angle_deg") + F.col("rear_slip_angle_deg") for k, m in enumerate(setups.AXLE_METRICS)}
    rows = _sweep(spark, sf_dir).withColumns({"wheel": wheel} | metrics)
    return setups.sweep_rollup(rows).select("sweep_id", "parameter_value", *_AXLES)


_DATASET = (
    "SELECT s.seed, point_id, parameter_value - b AS parameter_delta_from_baseline, abs(parameter_value - b) AS absolute_parameter_delta_from_baseline, "
    f"front_slip_angle_deg FROM ({SWEEP_SQL}) s JOIN (SELECT seed, avg(parameter_value) AS b FROM ({SWEEP_SQL}) GROUP BY seed) USING (seed)"
)


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _sweep(spark, sf_dir)
    return setups.ml_dataset(points, points.groupBy("seed").agg(F.avg("parameter_value").alias("baseline_value")))


@query(_DATASET, "parameter_delta_from_baseline absolute_parameter_delta_from_baseline front_slip_angle_deg")
def i1_ml_dataset(spark, sf_dir):
    return _dataset(spark, sf_dir).select("seed", "point_id", "parameter_delta_from_baseline", "absolute_parameter_delta_from_baseline", "front_slip_angle_deg")


_SPLIT = f"SELECT seed, row_number() OVER (ORDER BY md5(concat(seed, ':42'))) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT seed FROM ({_DATASET}))"


@query(f"SELECT seed, is_test, 1 AS sides, count(*) AS rows FROM ({_DATASET}) JOIN ({_SPLIT}) USING (seed) GROUP BY ALL")
def i2_group_split(spark, sf_dir):
    return learn.group_split(_dataset(spark, sf_dir)).groupBy("seed").agg(F.min("is_test").alias("is_test"), F.countDistinct("is_test").alias("sides"), F.count(F.lit(1)).alias("rows"))


_X, _Y = "absolute_parameter_delta_from_baseline", "front_slip_angle_deg"


@query(f"SELECT seed, regr_slope({_Y}, {_X}) AS coefficient, regr_intercept({_Y}, {_X}) AS intercept, count(*) AS rows FROM ({_DATASET}) GROUP BY seed", "coefficient intercept")
def i3_regression_by_seed(spark, sf_dir):
    return learn.simple_regression(_dataset(spark, sf_dir), ("seed",))


@query(
    "SELECT seed, count(*) AS rows, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, "
    f"1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM (SELECT seed, {_Y} AS y, c * {_X} + i AS p FROM ({_DATASET}) JOIN "
    f"(SELECT seed, regr_slope({_Y}, {_X}) AS c, regr_intercept({_Y}, {_X}) AS i FROM ({_DATASET}) GROUP BY seed) USING (seed)) GROUP BY seed",
    "mae rmse r2",
)
def i5_metrics_by_seed(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    return learn.metrics(learn.predict_line(data, learn.simple_regression(data, ("seed",)), ("seed",)), ("seed",))


_SUMS = f"SELECT CAST(count(*) AS DOUBLE) AS n, {', '.join(f'sum(pow({_X}, {k})) AS x{k}' for k in (1, 2, 3, 4))}, sum({_Y}) AS y0, sum({_X} * {_Y}) AS y1, sum(pow({_X}, 2) * {_Y}) AS y2 FROM data WHERE NOT is_test"


@query(
    f"WITH data AS (SELECT * FROM ({_DATASET}) JOIN ({_SPLIT}) USING (seed)), line AS (SELECT regr_slope({_Y}, {_X}) AS a, regr_intercept({_Y}, {_X}) AS b FROM data WHERE NOT is_test), "
    f"curve AS (SELECT {', '.join(f'{e} / {learn.PARABOLA["d"]} AS {c}' for c, e in learn.PARABOLA.items() if c != 'd')} FROM ({_SUMS})), "
    f"scored AS (SELECT 'linear' AS model, {_Y} AS y, (SELECT b FROM line) + (SELECT a FROM line) * {_X} AS p FROM data WHERE is_test UNION ALL "
    f"SELECT 'polynomial_2', {_Y}, (SELECT c0 FROM curve) + (SELECT c1 FROM curve) * {_X} + (SELECT c2 FROM curve) * {_X} * {_X} FROM data WHERE is_test) "
    "SELECT model, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM scored GROUP BY model",
    "mae rmse r2",
)
def i4_model_comparison(spark, sf_dir):
    """A line and a parabola by least squares on the same split."""
    return learn.compare_curves(learn.group_split(_dataset(spark, sf_dir))).drop("rows")


@query()
def i4_random_forest(spark, sf_dir):
    """The three models of the machine learning library on that split, with the forest."""
    return learn.compare_models(learn.group_split(_dataset(spark, sf_dir))).drop("rows")


_RUNS = (
    "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'polynomial_2' "
    "ELSE 'random_forest' END AS model, 0.1e0 + s_suppkey % 17 / 100e0 AS mae, 0.2e0 + s_suppkey % 13 / 100e0 AS rmse, 0.5e0 + s_suppkey % 41 / 100e0 "
    "AS r2, s_nationkey AS dataset FROM supplier"
)


@query(
    "SELECT count(*) AS run_count, string_agg(DISTINCT model, ',' ORDER BY model) AS models, avg(mae) AS average_mae, avg(rmse) AS average_rmse, avg(r2) "
    f"AS average_r2, min(mae) AS best_mae, max(r2) AS best_r2, count(DISTINCT dataset) AS dataset_count FROM ({_RUNS})",
    "average_mae average_rmse average_r2 best_mae best_r2",
)
def d13_run_analytics(spark, sf_dir):
    _table(spark, sf_dir, "supplier").createOrReplaceTempView("paddock_supplier")
    return learn.run_analytics(spark.sql(_RUNS.replace("FROM supplier", "FROM paddock_supplier")))


_FASTER = f"SELECT *, CASE WHEN event_id % 89 = 3 THEN vehicle_speed_kmh + 1 ELSE vehicle_speed_kmh END AS faster FROM ({VALID_SQL})"
_FAR = "abs({0} - {1}) > greatest(1e-6 * greatest(abs({0}), abs({1})), 1e-6)"
_FAILED = f"CAST({_FAR.format('ma', 'mb')} AS INTEGER) + CAST({_FAR.format('aa', 'ab')} AS INTEGER)"


@query(
    f"SELECT session_id, n AS a_rows, n AS b_rows, CAST(0 AS BIGINT) AS unpaired_frames, {_FAILED} AS failed_metrics, greatest(abs(ma - mb), abs(aa - ab)) "
    f"AS maximum_difference, {_FAILED} = 0 AS is_equal "
    f"FROM (SELECT session_id, count(*) AS n, max(vehicle_speed_kmh) AS ma, max(faster) AS mb, avg(vehicle_speed_kmh) AS aa, avg(faster) AS ab FROM ({_FASTER}) GROUP BY session_id)",
    "maximum_difference",
)
def e32_parity(spark, sf_dir):
    """Silver against a copy with a faster speed in some frames: those sessions differ."""
    a = _valid(spark, sf_dir)
    b = a.withColumn("vehicle_speed_kmh", F.when(F.col("event_id") % 89 == 3, F.col("vehicle_speed_kmh") + 1).otherwise(F.col("vehicle_speed_kmh")))
    return parity.compare(a, b)


@query(f"SELECT session_id, lap_number, CAST(count(*) AS INTEGER) - 1 AS last_index, max(progress) AS last_progress FROM ({TRACE_SQL}) GROUP BY 1, 2", "last_progress")
def a10_trace_numbering(spark, sf_dir):
    rows = trace_files.numbered(trace(spark, sf_dir).withColumn("lap_time_ms", F.lit(90000)).drop("sample_index"))
    return rows.groupBy(*traces.LAP).agg(F.max("sample_index").alias("last_index"), F.max_by("progress", "sample_index").alias("last_progress"))


@query(
    f"SELECT session_id, count(*) AS rows FROM ({VALID_SQL}) GROUP BY session_id",
)
def h2_streamed_silver(spark, sf_dir):
    """The streaming stages over all frames as files, with a watermark wide enough to lose none."""
    folder = f"{shared_folder(spark)}/stream"
    run = f"{folder}/{uuid.uuid4().hex}"
    source = telemetry(spark, sf_dir)
    source.write.parquet(f"{run}/in")
    stages.frames_chain(spark, f"{run}/in", source.schema, f"{run}/out", stages.Settings(source.schema.simpleString(), watermark="60 days", files_per_trigger=1000)).run()
    return spark.read.parquet(f"{run}/out/silver").groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))


_FLAGGED = lap_queries._FLAGS_SQL


@query(
    "SELECT source_id, session_number, arrival, 'lap' AS kind, completed_laps AS lap_number, CAST(NULL AS BIGINT) AS sector_number, greatest(0, "
    "last_time_ms) AS time_ms, last_time_ms > 0 AND best_time_ms > 0 AND last_time_ms <= best_time_ms AS is_best "
    f"FROM ({_FLAGGED}) WHERE lap_completed UNION ALL SELECT source_id, session_number, arrival, 'sector', greatest(1, CASE "
    "WHEN lap_completed THEN completed_laps ELSE completed_laps + 1 END), greatest(0, sector_before) + 1, greatest(0, last_sector_time_ms), NULL "
    f"FROM ({_FLAGGED}) WHERE sector_changed"
)
def h10_live_events(spark, sf_dir):
    """The stateful stream over all snapshots as files."""
    run = f"{shared_folder(spark)}/live/{uuid.uuid4().hex}"
    source = lap_queries.snapshots(spark, sf_dir)
    source.write.parquet(f"{run}/in")
    stages.start(live.live_events(stages.read_stream(spark, f"{run}/in", source.schema, 1000)), f"{run}/out", "events").awaitTermination()
    return spark.read.parquet(f"{run}/out/events")
