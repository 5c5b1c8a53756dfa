"""Telemetry, laps and traces derived from the driver's tables, as DataFrames and as SQL of the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.schemas import WHEEL_FIELDS, WHEELS

#: Column: (lowest value, step divisor, multiplier, offset, number of steps); value = lowest + ((event_id * multiplier + offset) % steps) / divisor
VEHICLE_RULES = {
    "vehicle_speed_kmh": (60, 2, 17, 3, 401), "vehicle_throttle": (0, 100, 7, 0, 101), "vehicle_brake": (0, 100, 13, 0, 101),
    "vehicle_clutch": (0, 10, 3, 1, 11), "vehicle_steering_angle_deg": (-30, 1, 37, 0, 61), "vehicle_lateral_g": (-2, 50, 29, 5, 201),
    "vehicle_longitudinal_g": (-1.5, 40, 31, 7, 101), "vehicle_brake_bias": (0.5, 100, 1, 0, 11), "environment_air_temperature_c": (18, 10, 1, 2, 51),
    "environment_track_temperature_c": (25, 10, 3, 4, 81), "environment_grip_level": (0.9, 100, 1, 3, 11),
}
WHEEL_RULES = {
    "pressure_psi": (22, 10, 61), "tyre_temp_inner_c": (70, 4, 121), "tyre_temp_middle_c": (68, 4, 117), "tyre_temp_outer_c": (66, 4, 113),
    "tyre_temp_core_c": (72, 5, 119), "brake_temp_c": (200, 1, 301), "wheel_speed_kmh": (60, 2, 397), "load_n": (2000, 1, 1999),
    "slip_ratio": (-0.2, 100, 41), "slip_angle_deg": (-6, 10, 127), "suspension_travel_mm": (10, 2, 151),
}


def _rule(lowest: float, divisor: int, times: int, plus: int, steps: int) -> str:
    return f"{float(lowest)}e0 + ((event_id * {times} + {plus}) % {steps}) / {divisor}e0"


CHANNELS = {c: _rule(*r) for c, r in VEHICLE_RULES.items()} | {
    f"{w.lower()}_{f}": _rule(WHEEL_RULES[f][0], WHEEL_RULES[f][1], 11 + 6 * k + 2 * j, 5 * k + j, WHEEL_RULES[f][2])
    for k, w in enumerate(WHEELS)
    for j, f in enumerate(WHEEL_FIELDS)
}
#: Every 97th frame has a control out of range, every 89th no speed, every 83rd a negative load
CHANNELS["vehicle_throttle"] = f"CASE WHEN event_id % 97 = 0 THEN 1.5e0 ELSE {CHANNELS['vehicle_throttle']} END"
CHANNELS["vehicle_speed_kmh"] = f"CASE WHEN event_id % 89 = 0 THEN NULL ELSE {CHANNELS['vehicle_speed_kmh']} END"
CHANNELS["fl_load_n"] = f"CASE WHEN event_id % 83 = 0 THEN -5e0 ELSE {CHANNELS['fl_load_n']} END"
_FRAME = {
    "session_id": "concat('s', CAST(user_id AS {string}))", "car_id": "concat('car', CAST(user_id % 5 AS {string}))", "track_id": "concat('track', CAST(user_id % 3 AS {string}))",
    "setup_id": "concat('setup', CAST(user_id % 7 AS {string}))", "session_type": "CASE user_id % 4 WHEN 0 THEN 'practice' WHEN 1 THEN 'qualifying' WHEN 2 THEN 'race' ELSE 'test' END",
    "telemetry_source": "'events'", "elapsed_seconds": "sample_index * 0.5e0", "vehicle_rpm": "4000 + (event_id * 19) % 4001", "vehicle_gear": "event_id % 7 - 1",
    "vehicle_fuel_l": "60e0 - sample_index / 64e0",
}
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index FROM events"


def _frame(string: str, times: str) -> str:
    columns = [f"{e.format(string=string)} AS {c}" for c, e in (_FRAME | CHANNELS).items()]
    return f"{times} AS timestamp, event_id, CAST(sample_index AS BIGINT) AS sample_index, " + ", ".join(columns)


#: Each frame once; the second SELECT repeats every 50th as a duplicate sample
TELEMETRY_SQL = f"SELECT {_frame('VARCHAR', 'ts')} FROM ({_NUMBERED}) UNION ALL SELECT {_frame('VARCHAR', 'ts')} FROM ({_NUMBERED}) WHERE event_id % 50 = 0"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    numbered = events.withColumn("sample_index", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    repeated = numbered.withColumn("copy", F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    columns = [F.expr(e.format(string="STRING")).alias(c) for c, e in (_FRAME | CHANNELS).items()]
    return repeated.select(F.col("ts").cast("timestamp").alias("timestamp"), "event_id", F.col("sample_index").cast("long").alias("sample_index"), *columns)


LAPS_SQL = (
    "SELECT concat('s', CAST(o_custkey AS VARCHAR)) AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS lap_number, "
    "CAST(60000 + (o_orderkey * 37) % 30011 AS INTEGER) * CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 1 END AS lap_time_ms, o_orderdate AS occurred_at, o_orderkey AS lap_key FROM orders"
)
SECTORS_SQL = (
    "SELECT l.session_id, l.lap_number, l_linenumber AS sector_number, CAST(min(CAST(l_quantity * 1000 AS INTEGER) + l_partkey % 500) AS INTEGER) AS sector_time_ms "
    f"FROM ({LAPS_SQL}) l JOIN lineitem ON l_orderkey = lap_key GROUP BY l.session_id, l.lap_number, l_linenumber"
)


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lap for each order, numbered within its customer's session."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    time = (60000 + (F.col("o_orderkey") * 37) % 30011).cast("int") * F.when(F.col("o_orderkey") % 23 == 0, 0).otherwise(1)
    return orders.select(
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"), number.cast("int").alias("lap_number"), time.alias("lap_time_ms"),
        F.col("o_orderdate").alias("occurred_at"), F.col("o_orderkey").alias("lap_key"),
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sector for each line number of a lap's order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") * 1000).cast("int") + F.col("l_partkey") % 500).alias("ms"))
    joined = laps(spark, sf_dir).join(items, F.col("lap_key") == F.col("l_orderkey"))
    return joined.groupBy("session_id", "lap_number", F.col("l_linenumber").alias("sector_number")).agg(F.min("ms").cast("int").alias("sector_time_ms"))


#: Two corners a lap, at c1 and c2. Laps differ in braking points, pressure, release, steering, throttle and pace, so that each kind of difference occurs
_TRACE = {
    "brake": "CASE WHEN p >= c1 - 0.11e0 AND p < c1 - release THEN (0.75e0 + 0.05e0 * (lap % 4)) * (c1 - 0.015e0 - p) / 0.095e0 WHEN p >= c2 - 0.11e0 AND p < c2 - release THEN (0.75e0 + 0.05e0 * (lap % 4)) * (c2 - 0.015e0 - p) / 0.095e0 ELSE 0e0 END",
    "throttle": "CASE WHEN (p >= c1 - 0.11e0 AND p < c1 - 0.015e0) OR (p >= c2 - 0.11e0 AND p < c2 - 0.015e0) THEN 0e0 WHEN p >= c1 - 0.015e0 AND p <= c1 + 0.11e0 THEN least(1e0, greatest(0e0, (p - c1) / (0.07e0 + 0.01e0 * (lap % 5)))) "
    "WHEN p >= c2 - 0.015e0 AND p <= c2 + 0.11e0 THEN least(1e0, greatest(0e0, (p - c2) / (0.07e0 + 0.01e0 * (lap % 5)))) ELSE 1e0 END",
    "speed_kmh": "160e0 - (85 + 3 * (lap % 4)) * h",
    "steering_angle_deg": "(18e0 + 3 * (lap % 3)) * h",
    "elapsed_seconds": "k * (0.6e0 + 0.006e0 * (lap % 7))",
}
_TRACE_NUMBERED = "SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem"
_TRACE_PLACED = (
    "SELECT *, 0.35e0 + (lap % 5) * 0.006e0 AS c1, 0.72e0 - (lap % 4) * 0.006e0 + CASE WHEN lap % 6 = 0 THEN 0.09e0 "
    "ELSE 0e0 END AS c2, 0.015e0 + 0.01e0 * (lap % 3) AS release FROM (SELECT l_suppkey, CAST({div} + 1 AS INTEGER) AS lap, CAST(i % 100 AS INTEGER) AS k, "
    "(i % 100) / 99e0 AS p FROM ({numbered}))"
)
_TRACE_SHAPED = "SELECT *, greatest(0e0, 1 - abs(p - c1) / 0.11e0) + greatest(0e0, 1 - abs(p - c2) / 0.11e0) AS h FROM ({placed})"


def _trace_sql(string: str, div: str) -> str:
    shaped = _TRACE_SHAPED.format(placed=_TRACE_PLACED.format(div=div, numbered=_TRACE_NUMBERED))
    columns = ", ".join(f"{e} AS {c}" for c, e in _TRACE.items())
    return (
        f"SELECT concat('s', CAST(l_suppkey AS {string})) AS session_id, lap AS lap_number, concat('car', CAST(l_suppkey % 5 AS {string})) AS car_id, "
        f"concat('track', CAST(l_suppkey % 3 AS {string})) AS track_id, "
        f"k AS sample_index, p AS progress, {columns}, CAST(2 + k % 4 AS INTEGER) AS gear, CASE WHEN k % 9 = 0 THEN NULL ELSE (k % 5) / 5e0 END AS clutch FROM ({shaped})"
    )


TRACE_SQL = _trace_sql("VARCHAR", "i // 100")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of up to 100 samples for each supplier's line items."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").createOrReplaceTempView("paddock_lineitem")
    return spark.sql(_trace_sql("STRING", "i div 100").replace("FROM lineitem", "FROM paddock_lineitem"))


#: Laps of a session compared with its lap 1
PAIRS_SQL = f"SELECT DISTINCT session_id, 1 AS ref_lap, lap_number AS target_lap FROM ({TRACE_SQL}) WHERE lap_number >= 2"


def pairs(trace: DataFrame) -> DataFrame:
    return trace.where("lap_number >= 2").select("session_id", F.lit(1).alias("ref_lap"), F.col("lap_number").alias("target_lap")).distinct()
