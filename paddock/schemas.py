"""Explicit schemas of raw and stored tables, and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WHEELS = ("FL", "FR", "RL", "RR")
WHEEL_FIELDS = (
    "pressure_psi", "tyre_temp_inner_c", "tyre_temp_middle_c", "tyre_temp_outer_c", "tyre_temp_core_c", "brake_temp_c",
    "wheel_speed_kmh", "load_n", "slip_ratio", "slip_angle_deg", "suspension_travel_mm",
)
VEHICLE_FIELDS = (
    "speed_kmh", "rpm", "gear", "throttle", "brake", "clutch", "steering_angle_deg", "lateral_g", "longitudinal_g", "fuel_l",
    "brake_bias", "pitch_deg", "roll_deg", "ride_height_front_mm", "ride_height_rear_mm",
)
ENVIRONMENT_FIELDS = ("air_temperature_c", "track_temperature_c", "grip_level")


def _struct(names: Iterable[str], longs: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType() if n in longs else T.DoubleType()) for n in names])


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def flat(ddl: str) -> T.StructType:
    """A schema of plain columns; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in ddl.split(","))])


VEHICLE, ENVIRONMENT, WHEEL = _struct(VEHICLE_FIELDS, ("rpm", "gear")), _struct(ENVIRONMENT_FIELDS), _struct(WHEEL_FIELDS)
FRAME = flat("timestamp timestamp, session_id string, sample_index long, elapsed_seconds double, car_id string, track_id string")
FRAME = T.StructType([*FRAME.fields, T.StructField("vehicle", VEHICLE), T.StructField("environment", ENVIRONMENT), T.StructField("wheels", T.MapType(T.StringType(), WHEEL))])
CONDITIONS = ENVIRONMENT
SESSION_METADATA = T.StructType(
    [
        *flat("session_id string, car_id string, track_id string, setup_id string, source string, session_type string, started_at timestamp, ended_at timestamp, sample_count long, duration_seconds double").fields,
        T.StructField("initial_conditions", CONDITIONS),
        T.StructField("final_conditions", CONDITIONS),
    ]
)
ENVELOPE = T.StructType([*flat("schema_version int, source string, session_type string, setup_id string").fields, T.StructField("frame", FRAME)])
BROKER_RECORD = flat("key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
BRONZE = T.StructType(
    [
        *FRAME.fields[:6],
        *flat("setup_id string, session_type string, telemetry_source string, source_file string, ingested_at timestamp, schema_version int").fields,
        *(T.StructField(f"vehicle_{f.name}", f.dataType) for f in VEHICLE.fields),
        *(T.StructField(f"environment_{f.name}", f.dataType) for f in ENVIRONMENT.fields),
        *(T.StructField(f"{w.lower()}_{f}", T.DoubleType()) for w in WHEELS for f in WHEEL_FIELDS),
    ]
)
LAPS = flat("session_id string, lap_number int, lap_time_ms int, best_lap_time_ms int, is_best boolean, position int, is_in_pit boolean, is_in_pit_lane boolean, occurred_at timestamp")
SECTORS = flat("session_id string, lap_number int, sector_index int, sector_number int, sector_time_ms int, position int, is_in_pit boolean, is_in_pit_lane boolean, occurred_at timestamp")
TRACE = flat(
    "session_id string, lap_number int, car_id string, track_id string, lap_time_ms int, sample_index int, progress double, elapsed_seconds double, "
    "speed_kmh double, throttle double, brake double, steering_angle_deg double, gear int, clutch double"
)
SWEEP = flat(
    "parameter_value double, experiment_id string, front_pressure_psi double, rear_pressure_psi double, front_core_temp_c double, rear_core_temp_c double, "
    "front_brake_temp_c double, rear_brake_temp_c double, front_suspension_travel_mm double, rear_suspension_travel_mm double, front_slip_angle_deg double, rear_slip_angle_deg double, maximum_lateral_g double"
)
SESSION_TYPES = ("practice", "qualifying", "race", "hotlap", "test")


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """``df`` itself; raises if a column is missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df
