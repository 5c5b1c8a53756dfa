"""Braking zones, corner entries, corner exits and corners of each lap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.sessions import runs
from paddock.operators.traces import LAP


def _numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*LAP).orderBy(*order)))


def braking_zones(trace: DataFrame, threshold: float = 0.1, minimum_samples: int = 2) -> DataFrame:
    """Runs of samples with the brake at ``threshold`` or more, numbered after short ones are left out."""
    at = F.struct("progress", "sample_index")
    marked = runs(trace, F.col("brake") >= threshold, LAP, ("progress", "sample_index"), "__run").where("__on")
    zones = marked.groupBy(*LAP, "__run").agg(
        F.min_by("progress", at).alias("start_progress"), F.max_by("progress", at).alias("end_progress"), F.min_by("elapsed_seconds", at).alias("start_elapsed_seconds"), F.max_by("elapsed_seconds", at).alias("end_elapsed_seconds"),
        F.min_by("speed_kmh", at).alias("entry_speed_kmh"), F.min("speed_kmh").alias("minimum_speed_kmh"), F.max_by("speed_kmh", at).alias("exit_speed_kmh"), F.max("brake").alias("peak_brake"), F.avg("brake").alias("mean_brake"),
        F.count(F.lit(1)).alias("sample_count"),
    ).where(F.col("sample_count") >= minimum_samples)
    zones = zones.withColumns({"center_progress": (F.col("start_progress") + F.col("end_progress")) / 2, "duration_seconds": F.greatest(F.lit(0.0), F.col("end_elapsed_seconds") - F.col("start_elapsed_seconds"))})
    return _numbered(zones, "zone_number", "__run").drop("__run")


def _from(df: DataFrame, parent: str):
    return Window.partitionBy(*LAP, parent).orderBy("progress", "sample_index"), Window.partitionBy(*LAP, parent)


def corner_entries(trace: DataFrame, zones: DataFrame, after: float = 0.08, steering_deg: float = 5.0, minimum_samples: int = 2) -> DataFrame:
    """From the first sample of a zone's stretch with the wheel turned to the slowest one after it (the apex)."""
    zone = zones.select(*LAP, F.col("zone_number").alias("source_braking_zone_number"), F.col("start_progress").alias("braking_start_progress"), F.col("end_progress").alias("brake_release_progress"), F.col("end_elapsed_seconds").alias("brake_release_elapsed_seconds"))
    inside = F.col("progress").between(F.col("braking_start_progress"), F.least(F.lit(1.0), F.col("brake_release_progress") + after))
    order, whole = _from(trace, "source_braking_zone_number")
    joined = trace.drop("car_id", "track_id").join(zone, list(LAP)).where(inside).withColumn("__n", F.row_number().over(order))
    turned = joined.withColumn("__turn", F.min(F.when(F.abs("steering_angle_deg") >= steering_deg, F.col("__n"))).over(whole)).where("__n >= __turn")
    apex = F.min_by("__n", F.struct("speed_kmh", "progress", "__n")).over(whole)
    part = turned.withColumns({"__apex": apex, "__count": F.count(F.lit(1)).over(whole)}).where(f"__count >= {minimum_samples} and __n <= __apex")
    first, last = (lambda c: F.min_by(c, "__n")), (lambda c: F.max_by(c, "__n"))
    out = part.groupBy(*LAP, "source_braking_zone_number", "braking_start_progress", "brake_release_progress", "brake_release_elapsed_seconds").agg(
        first("progress").alias("turn_in_progress"), last("progress").alias("apex_progress"), first("elapsed_seconds").alias("turn_in_elapsed_seconds"), last("elapsed_seconds").alias("apex_elapsed_seconds"),
        first("speed_kmh").alias("entry_speed_kmh"), last("speed_kmh").alias("apex_speed_kmh"), first("brake").alias("brake_at_turn_in"), first("throttle").alias("throttle_at_turn_in"), last("throttle").alias("throttle_at_apex"),
        first("steering_angle_deg").alias("steering_at_turn_in_deg"), F.max(F.abs("steering_angle_deg")).alias("maximum_abs_steering_deg"), F.avg(F.abs("steering_angle_deg")).alias("average_abs_steering_deg"), F.count(F.lit(1)).alias("sample_count"),
    ).where(F.col("sample_count") >= minimum_samples)
    zero = F.lit(0.0)
    out = out.withColumns(
        {
            "entry_duration_seconds": F.greatest(zero, F.col("apex_elapsed_seconds") - F.col("turn_in_elapsed_seconds")),
            "brake_overlap_seconds": F.greatest(zero, F.col("brake_release_elapsed_seconds") - F.col("turn_in_elapsed_seconds")),
            "speed_loss_kmh": F.greatest(zero, F.col("entry_speed_kmh") - F.col("apex_speed_kmh")),
        }
    )
    return _numbered(out, "entry_number", "source_braking_zone_number")


def corner_exits(trace: DataFrame, entries: DataFrame, after: float = 0.12, throttle: float = 0.2, exit_throttle: float = 0.7, exit_steering_deg: float = 8.0, minimum_samples: int = 2) -> DataFrame:
    """From an apex to the first sample with the throttle open and the wheel straight again."""
    entry = entries.select(*LAP, F.col("entry_number").alias("source_entry_number"), F.col("apex_progress").alias("__apex"))
    order, whole = _from(trace, "source_entry_number")
    joined = trace.drop("car_id", "track_id").join(entry, list(LAP)).where(F.col("progress").between(F.col("__apex"), F.least(F.lit(1.0), F.col("__apex") + after))).withColumn("__n", F.row_number().over(order))
    opened = joined.withColumn("__open", F.min(F.when(F.col("throttle") >= throttle, F.col("__n"))).over(whole))
    ready = (F.col("__n") >= F.col("__open")) & (F.col("throttle") >= exit_throttle) & (F.abs("steering_angle_deg") <= exit_steering_deg)
    part = opened.withColumn("__exit", F.min(F.when(ready, F.col("__n"))).over(whole)).where("__n <= __exit")
    first, last = (lambda c: F.min_by(c, "__n")), (lambda c: F.max_by(c, "__n"))
    on = lambda c: F.max(F.when(F.col("__n") == F.col("__open"), F.col(c)))
    out = part.groupBy(*LAP, "source_entry_number").agg(
        first("progress").alias("apex_progress"), last("progress").alias("exit_progress"), first("elapsed_seconds").alias("apex_elapsed_seconds"), last("elapsed_seconds").alias("exit_elapsed_seconds"),
        on("progress").alias("throttle_application_progress"), on("elapsed_seconds").alias("throttle_application_elapsed_seconds"), first("speed_kmh").alias("apex_speed_kmh"), last("speed_kmh").alias("exit_speed_kmh"),
        first("throttle").alias("throttle_at_apex"), last("throttle").alias("throttle_at_exit"), first("steering_angle_deg").alias("steering_at_apex_deg"), last("steering_angle_deg").alias("steering_at_exit_deg"),
        F.max(F.abs("steering_angle_deg")).alias("maximum_abs_steering_deg"), F.avg(F.abs("steering_angle_deg")).alias("average_abs_steering_deg"), F.count(F.lit(1)).alias("sample_count"),
    ).where(F.col("sample_count") >= minimum_samples)
    zero = F.lit(0.0)
    out = out.withColumns(
        {
            "duration_seconds": F.greatest(zero, F.col("exit_elapsed_seconds") - F.col("apex_elapsed_seconds")),
            "time_to_throttle_seconds": F.greatest(zero, F.col("throttle_application_elapsed_seconds") - F.col("apex_elapsed_seconds")),
            "speed_gain_kmh": F.col("exit_speed_kmh") - F.col("apex_speed_kmh"),
            "abs_steering_at_exit_deg": F.abs("steering_at_exit_deg"),
            "steering_unwind_deg": F.greatest(zero, F.abs("steering_at_apex_deg") - F.abs("steering_at_exit_deg")),
        }
    )
    return _numbered(out, "exit_number", "source_entry_number")


def corners(zones: DataFrame, entries: DataFrame, exits: DataFrame, apex_gap: float = 0.02) -> DataFrame:
    """Chains of a zone, its entry and its exit whose parts are in order and whose apexes agree, numbered by apex."""
    zone = zones.select(*LAP, "zone_number", "start_progress", "start_elapsed_seconds", "minimum_speed_kmh")
    entry = entries.select(*LAP, F.col("source_braking_zone_number").alias("zone_number"), "entry_number", "turn_in_progress", "apex_progress", "apex_speed_kmh")
    leave = exits.select(*LAP, F.col("source_entry_number").alias("entry_number"), "exit_number", F.col("apex_progress").alias("__exit_apex"), "throttle_application_progress", "exit_progress", "exit_elapsed_seconds", "exit_speed_kmh")
    chain = zone.join(entry, [*LAP, "zone_number"]).join(leave, [*LAP, "entry_number"])
    ordered = (F.col("start_progress") <= F.col("turn_in_progress")) & (F.col("turn_in_progress") <= F.col("apex_progress")) & (F.col("apex_progress") <= F.col("exit_progress"))
    kept = chain.where(ordered & (F.abs(F.col("apex_progress") - F.col("__exit_apex")) <= apex_gap)).drop("__exit_apex")
    kept = kept.withColumn("total_duration_seconds", F.greatest(F.lit(0.0), F.col("exit_elapsed_seconds") - F.col("start_elapsed_seconds")))
    return _numbered(kept, "corner_number", "apex_progress", "zone_number")


def unchained(zones: DataFrame, entries: DataFrame, exits: DataFrame, found: DataFrame) -> DataFrame:
    """Zones, entries and exits that belong to no corner."""
    parts = (("zone", zones, "zone_number"), ("entry", entries, "entry_number"), ("exit", exits, "exit_number"))
    rest = [df.join(found, [*LAP, number], "left_anti").select(*LAP, F.lit(kind).alias("part"), F.col(number).alias("number")) for kind, df, number in parts]
    return rest[0].unionByName(rest[1]).unionByName(rest[2])
