"""Raw simulator counters as flat frames in the units of Bronze."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.scalars import clamp, normalize_gear, wheel_speed_kmh
from paddock.schemas import WHEELS

#: Bronze wheel field: raw array of four, in the order of WHEELS
_ARRAYS = {
    "pressure_psi": "wheel_pressure_psi", "tyre_temp_inner_c": "tyre_temp_inner_c", "tyre_temp_middle_c": "tyre_temp_middle_c", "tyre_temp_outer_c": "tyre_temp_outer_c", "tyre_temp_core_c": "tyre_core_temp_c",
    "brake_temp_c": "brake_temp_c", "load_n": "wheel_load_n", "slip_ratio": "wheel_slip",
}


def _wheel(index: int) -> dict[str, Column]:
    at = lambda c: F.col(c)[index]
    return {f: at(c) for f, c in _ARRAYS.items()} | {
        "wheel_speed_kmh": wheel_speed_kmh(at("wheel_angular_speed_rad_s"), at("tyre_radius_m")),
        "slip_angle_deg": F.lit(0.0),  # the raw counters have none
        "suspension_travel_mm": at("suspension_travel_m") * 1000.0,
    }


def to_frames(raw: DataFrame, keep: tuple[str, ...] = ("timestamp", "session_id", "sample_index", "elapsed_seconds", "car_id", "track_id")) -> DataFrame:
    """Angles in degrees, lengths in mm, gears from -1, controls, bias and grip within 0..1, fuel not below 0."""
    vehicle = {
        "speed_kmh": F.col("speed_kmh"), "rpm": F.col("rpm"), "gear": normalize_gear(F.col("gear_raw")), "throttle": clamp(F.col("gas")), "brake": clamp(F.col("brake")), "clutch": clamp(F.col("clutch")),
        "steering_angle_deg": F.degrees("steer_angle_rad"), "lateral_g": F.col("lateral_g"), "longitudinal_g": F.col("longitudinal_g"), "fuel_l": F.greatest(F.lit(0.0), F.col("fuel_l")), "brake_bias": clamp(F.col("brake_bias")),
        "pitch_deg": F.degrees("pitch_rad"), "roll_deg": F.degrees("roll_rad"), "ride_height_front_mm": F.col("ride_height_m")[0] * 1000.0, "ride_height_rear_mm": F.col("ride_height_m")[1] * 1000.0,
    }
    environment = {"air_temperature_c": F.col("air_temp_c"), "track_temperature_c": F.col("road_temp_c"), "grip_level": clamp(F.col("surface_grip"))}
    wheels = {f"{w.lower()}_{f}": c for i, w in enumerate(WHEELS) for f, c in _wheel(i).items()}
    return raw.select(*keep, *(c.alias(f"vehicle_{n}") for n, c in vehicle.items()), *(c.alias(f"environment_{n}") for n, c in environment.items()), *(c.alias(n) for n, c in wheels.items()))
