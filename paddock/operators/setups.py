"""Setups, experiments and parameter sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.storage import stored
from paddock.operators import sessions

AXLE_METRICS = ("pressure_psi", "core_temp_c", "brake_temp_c", "suspension_travel_mm", "slip_angle_deg")


def parameters(setups: DataFrame) -> DataFrame:
    """A row for each value of a setup's map."""
    return setups.select("setup_id", "car_id", F.explode("values").alias("parameter", "value"))


def setup_violations(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values that their car doesn't define, or that lie outside its range. ``ranges``: car_id, parameter, minimum, maximum."""
    known = ranges.select("car_id", "parameter", "minimum", "maximum")
    problem = F.when(F.col("minimum").isNull(), "unknown_parameter").when(~F.col("value").between(F.col("minimum"), F.col("maximum")), "out_of_range")
    return values.join(known, ["car_id", "parameter"], "left").withColumn("problem", problem).where("problem is not null").select("setup_id", "car_id", "parameter", "value", "problem")


def setup_diff(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parameters that both setups of a pair have with different values. Setups of different cars give nothing."""
    side = lambda n: values.select(F.col("setup_id").alias(f"{n}_setup"), "car_id", "parameter", F.col("value").alias(f"{n}_value"))
    both = pairs.join(side("previous"), "previous_setup").join(side("new"), ["new_setup", "car_id", "parameter"])
    return both.where("previous_value != new_value").select("previous_setup", "new_setup", "car_id", "parameter", "previous_value", "new_value", (F.col("new_value") - F.col("previous_value")).alias("delta"))


def _long(report: DataFrame, area: str) -> DataFrame:
    keys = [c for c in ("session_id", "wheel") if c in report.columns]
    metrics = [c for c, t in report.dtypes if c not in keys and t in ("double", "bigint", "int")]
    out = report.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m"))
    wheel = F.col("wheel") if "wheel" in keys else F.lit("all")
    return out.select("session_id", F.lit(area).alias("area"), wheel.alias("wheel"), "m.metric", "m.value")


def session_reports(frames: DataFrame) -> DataFrame:
    """All report metrics of each session in long form."""
    parts = [
        _long(sessions.tyre_report(frames), "tyre"), _long(sessions.brake_wheels(frames), "brake"), _long(sessions.brake_report(frames).drop("sample_count"), "brake"),
        _long(sessions.suspension_report(frames), "suspension"), _long(sessions.dynamics_report(frames).drop("sample_count"), "dynamics"),
    ]
    return reduce(DataFrame.unionByName, parts)


def compare_experiments(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Every metric of a baseline and a candidate session on the same car and track, with candidate minus baseline."""
    places = frames.select("session_id", "car_id", "track_id").distinct()
    side = lambda n: places.select(F.col("session_id").alias(f"{n}_session"), "car_id", "track_id")
    same = pairs.join(side("baseline"), "baseline_session").join(side("candidate"), ["candidate_session", "car_id", "track_id"])
    reports = stored(session_reports(frames), "session-reports")  # both sides read it
    part = lambda n: reports.select(F.col("session_id").alias(f"{n}_session"), "area", "wheel", "metric", F.col("value").alias(f"{n}_value"))
    both = same.join(part("baseline"), "baseline_session").join(part("candidate"), ["candidate_session", "area", "wheel", "metric"])
    return both.select("baseline_session", "candidate_session", "area", "wheel", "metric", "baseline_value", "candidate_value", (F.col("candidate_value") - F.col("baseline_value")).alias("delta"))


def sweep_rollup(comparison: DataFrame) -> DataFrame:
    """Axle means of a sweep's candidates from rows per wheel: one row for each (sweep, value)."""
    axle = F.when(F.col("wheel").isin("FL", "FR"), "front").otherwise("rear")
    return comparison.groupBy("sweep_id", "parameter_value").agg(
        *(F.avg(F.when(axle == a, F.col(m))).alias(f"{a}_{m}") for m in AXLE_METRICS for a in ("front", "rear"))
    )


def sweep_features(sweep: DataFrame, baseline: float) -> DataFrame:
    """Deltas from the baseline value and front minus rear of the axle metrics."""
    delta = F.col("parameter_value") - baseline
    return sweep.withColumns(
        {"parameter_delta_from_baseline": delta, "absolute_parameter_delta_from_baseline": F.abs(delta)}
        | {f"front_rear_{m}_delta": F.col(f"front_{m}") - F.col(f"rear_{m}") for m in AXLE_METRICS if f"front_{m}" in sweep.columns}
    )


def sweep_eda(sweep: DataFrame, by: tuple[str, ...] = ("sweep_id",), parameter: str = "parameter_value", slip: str = "front_slip_angle_deg") -> DataFrame:
    """Per sweep: rows, range of the parameter, and where the front slip is least (the first of equals)."""
    return sweep.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(parameter).alias("minimum_value"), F.max(parameter).alias("maximum_value"), F.min_by(parameter, F.struct(slip, parameter)).alias("minimum_slip_value"), F.min(slip).alias("minimum_slip"))


def sweep_correlations(sweep: DataFrame, by: tuple[str, ...] = ("sweep_id",), parameter: str = "parameter_value") -> DataFrame:
    """Pearson correlation of every numeric column with the parameter; null with fewer than two pairs or values."""
    metrics = [c for c, t in sweep.dtypes if t == "double" and c not in (*by, parameter)]
    long = sweep.select(*by, F.col(parameter).alias("__p"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")).where("m.value is not null and __p is not null")
    x, y = F.col("__p"), F.col("m.value")
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return long.groupBy(*by, "m.metric").agg(F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("correlation"))


def ml_dataset(points: DataFrame, baselines: DataFrame) -> DataFrame:
    """Sweep points of each seed with their deltas from that seed's baseline, and front minus rear, sorted by seed and value. ``baselines``: seed, baseline_value."""
    delta = F.col("parameter_value") - F.col("baseline_value")
    rows = points.join(baselines, "seed").withColumns({"parameter_delta_from_baseline": delta, "absolute_parameter_delta_from_baseline": F.abs(delta)})
    return rows.withColumns({f"front_rear_{m}_delta": F.col(f"front_{m}") - F.col(f"rear_{m}") for m in AXLE_METRICS if f"front_{m}" in points.columns}).orderBy("seed", "parameter_value")
