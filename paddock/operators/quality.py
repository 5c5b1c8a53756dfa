"""Silver: axle features, quality flags, quarantine, de-duplication and identity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.schemas import require_columns

#: Feature stem and unit, and the wheel field it averages over an axle
_AXLE = {"pressure_psi": "pressure_psi", "core_temp_c": "tyre_temp_core_c", "brake_temp_c": "brake_temp_c", "suspension_travel_mm": "suspension_travel_mm", "slip_angle_deg": "slip_angle_deg"}
_DELTA = {"pressure_psi": "front_rear_pressure_delta_psi", "core_temp_c": "front_rear_core_temp_delta_c", "brake_temp_c": "front_rear_brake_temp_delta_c", "suspension_travel_mm": "front_rear_suspension_delta_mm", "slip_angle_deg": "front_rear_slip_delta_deg"}
CONTROLS = ("vehicle_throttle", "vehicle_brake", "vehicle_clutch")
POSITIVE = tuple(f"{w}_pressure_psi" for w in ("fl", "fr", "rl", "rr"))
NOT_NEGATIVE = ("vehicle_speed_kmh", "vehicle_rpm", "vehicle_fuel_l", "sample_index", "elapsed_seconds", *(f"{w}_{f}" for w in ("fl", "fr", "rl", "rr") for f in ("load_n", "suspension_travel_mm")))
REQUIRED = (
    "timestamp", "session_id", "car_id", "track_id", "sample_index", "elapsed_seconds", "vehicle_speed_kmh", "vehicle_rpm", *CONTROLS, "vehicle_fuel_l",
    "environment_grip_level", *(f"{w}_{f}" for w in ("fl", "fr", "rl", "rr") for f in ("pressure_psi", "tyre_temp_core_c", "brake_temp_c", "load_n", "slip_angle_deg", "suspension_travel_mm")),
)
FLAGS = ("quality_missing_required", "quality_invalid_controls", "quality_invalid_grip", "quality_invalid_physical")


def _mean(a: str, b: str, change=lambda c: c) -> Column:
    return (change(F.col(a)) + change(F.col(b))) / 2.0


def with_features(df: DataFrame) -> DataFrame:
    """Speed in m/s and 18 axle and side features. A null or NaN wheel value makes its features null or NaN."""
    made = {"vehicle_speed_mps": F.col("vehicle_speed_kmh") / 3.6}
    for name, field in _AXLE.items():
        change = F.abs if field == "slip_angle_deg" else (lambda c: c)
        made[f"front_{name}"], made[f"rear_{name}"] = _mean(f"fl_{field}", f"fr_{field}", change), _mean(f"rl_{field}", f"rr_{field}", change)
        made[_DELTA[name]] = made[f"front_{name}"] - made[f"rear_{name}"]
    made["left_load_n"], made["right_load_n"] = _mean("fl_load_n", "rl_load_n"), _mean("fr_load_n", "rr_load_n")
    made["left_right_load_delta_n"] = made["left_load_n"] - made["right_load_n"]
    return df.withColumns(made)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def with_flags(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Four flags, their number and ``is_valid``. Null controls or grip are invalid; null physical values only count as missing."""
    kinds = dict(df.dtypes)
    missing = [F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in required]
    outside = lambda c: ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    physical = [F.coalesce(F.col(c) <= 0, F.lit(False)) for c in POSITIVE] + [F.coalesce(F.col(c) < 0, F.lit(False)) for c in NOT_NEGATIVE]
    flags = dict(zip(FLAGS, (_any(missing), _any([outside(c) for c in CONTROLS]), outside("environment_grip_level"), _any(physical)), strict=True))
    return with_issue_count(df.withColumns(flags), FLAGS)


def with_issue_count(df: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    issues = reduce(lambda a, b: a + b, (F.col(f).cast("int") for f in flags))
    return df.withColumns({"quality_issue_count": issues, "is_valid": issues == 0})


def audited(df: DataFrame) -> DataFrame:
    """Features and flags on every row."""
    return with_flags(with_features(require_columns(df, REQUIRED)))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined)."""
    return df.where("is_valid"), df.where("not is_valid")


def deduplicate(df: DataFrame, key: tuple[str, ...] = ("session_id", "sample_index"), order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """The first row of each key in ``order``; of rows that tie there the one whose hash is smallest, so that the choice doesn't depend on their place."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order, F.xxhash64(*(c for c, t in df.dtypes if not t.startswith("map")))))
    return df.withColumn("__n", number).where("__n = 1").drop("__n")


def identity_audit(df: DataFrame, optional: tuple[str, ...] = ("setup_id",)) -> DataFrame:
    """Per session: numbers of distinct cars, tracks and optional values, and whether the session is a single one."""
    counts = [F.countDistinct(c).alias(f"n_{c}") for c in ("car_id", "track_id", *optional)]
    single = reduce(lambda a, b: a & b, [(F.col("n_car_id") == 1) & (F.col("n_track_id") == 1), *(F.col(f"n_{c}") <= 1 for c in optional)])
    return df.groupBy("session_id").agg(*counts).withColumn("is_single", single)


def partition_dates(df: DataFrame) -> DataFrame:
    """Per session the UTC date of its first frame."""
    return df.groupBy("session_id").agg(F.to_date(F.min("timestamp")).alias("date"))


def silver_rows(df: DataFrame, schema_version: int = 1) -> DataFrame:
    """De-duplicated frames with features, flags and audit columns."""
    return audited(deduplicate(df)).withColumns({"silver_processed_at": F.current_timestamp(), "silver_schema_version": F.lit(schema_version)})


def silver(df: DataFrame, schema_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) of ``silver_rows``."""
    return split(silver_rows(df, schema_version))
