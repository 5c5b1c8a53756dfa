"""Diagnostics, advice, coaching plan and report from the deltas of matched corners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.traces import PAIR

HIGH_LOSS, MEDIUM_LOSS, LEAST_LOSS = 0.4, 0.15, 0.05
_ISSUE = "source code center_progress severity time_loss_seconds reference_number evidence".split()


def severity(loss: Column, high: float = HIGH_LOSS, medium: float = MEDIUM_LOSS) -> Column:
    return F.when(loss >= high, "HIGH").when(loss >= medium, "MEDIUM").otherwise("LOW")


def _level(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).otherwise(2)


def _evidence(metric: str, field: str, unit: str, when: Column | None = None) -> Column:
    row = F.struct(F.lit(metric).alias("metric"), F.col(f"ref_{field}").alias("reference_value"), F.col(f"target_{field}").alias("target_value"), F.lit(unit).alias("unit"))
    return row if when is None else F.when(when, row)


def _issues(deltas: DataFrame, source: str, center: Column, rules: list[tuple[str, Column, list[Column]]], least: float) -> DataFrame:
    """A row for each rule that holds on a delta that loses ``least`` seconds or more, ranked within its pair."""
    made = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.filter(F.array(*evidence), lambda e: e.isNotNull()).alias("evidence"))) for code, cond, evidence in rules))
    rows = deltas.where(F.col("time_lost_seconds") >= least).select(
        *PAIR, F.lit(source).alias("source"), F.col("ref_number").alias("reference_number"), center.alias("center_progress"), F.col("time_lost_seconds").alias("time_loss_seconds"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")
    )
    out = rows.select(*PAIR, "source", "i.code", "center_progress", severity(F.col("time_loss_seconds")).alias("severity"), "time_loss_seconds", "reference_number", "i.evidence")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("time_loss_seconds"), "center_progress", "code")))


def braking_issues(deltas: DataFrame, least: float = LEAST_LOSS, point: float = 0.01, slowing_kmh: float = 3.0, release: float = 0.01, longer_seconds: float = 0.1, pressure: float = 0.08) -> DataFrame:
    d, place, speed = F.col, "normalized_progress", "km/h"
    harder, peak = d("mean_brake_delta") >= pressure, d("peak_brake_delta") >= pressure
    rules = [
        ("BRAKING_TOO_EARLY", d("start_progress_delta") <= -point, [_evidence("braking_start_progress", "start_progress", place)]),
        ("BRAKING_TOO_LATE", d("start_progress_delta") >= point, [_evidence("braking_start_progress", "start_progress", place)]),
        ("OVER_SLOWING", d("minimum_speed_kmh_delta") <= -slowing_kmh, [_evidence("minimum_speed", "minimum_speed_kmh", speed)]),
        (
            "LATE_BRAKE_RELEASE", (d("end_progress_delta") >= release) & (d("duration_seconds_delta") >= longer_seconds),
            [_evidence("brake_release_progress", "end_progress", place), _evidence("braking_duration", "duration_seconds", "s")],
        ),
        ("EXCESSIVE_BRAKE_PRESSURE", harder | peak, [_evidence("average_brake", "mean_brake", "normalized"), _evidence("peak_brake", "peak_brake", "normalized")]),
    ]
    return _issues(deltas, "BRAKING", d("ref_center_progress"), rules, least)


def entry_issues(deltas: DataFrame, least: float = LEAST_LOSS, turn_in: float = 0.01, slowing_kmh: float = 3.0, overlap_seconds: float = 0.15, brake: float = 0.08, steering_max_deg: float = 3.0, steering_mean_deg: float = 2.0) -> DataFrame:
    d, place, speed = F.col, "normalized_progress", "km/h"
    rules = [
        ("EARLY_TURN_IN", d("turn_in_progress_delta") <= -turn_in, [_evidence("turn_in_progress", "turn_in_progress", place)]),
        ("LATE_TURN_IN", d("turn_in_progress_delta") >= turn_in, [_evidence("turn_in_progress", "turn_in_progress", place)]),
        ("ENTRY_OVER_SLOWING", d("speed_loss_kmh_delta") >= slowing_kmh, [_evidence("entry_speed_loss", "speed_loss_kmh", speed)]),
        ("POOR_APEX_SPEED", d("apex_speed_kmh_delta") <= -slowing_kmh, [_evidence("apex_speed", "apex_speed_kmh", speed)]),
        (
            "EXCESSIVE_TRAIL_BRAKING", (d("brake_overlap_seconds_delta") >= overlap_seconds) & (d("brake_at_turn_in_delta") >= brake),
            [_evidence("brake_overlap", "brake_overlap_seconds", "s"), _evidence("brake_at_turn_in", "brake_at_turn_in", "normalized")],
        ),
        (
            "EXCESSIVE_STEERING", (d("maximum_abs_steering_deg_delta") >= steering_max_deg) | (d("average_abs_steering_deg_delta") >= steering_mean_deg),
            [_evidence("maximum_steering", "maximum_abs_steering_deg", "deg"), _evidence("average_steering", "average_abs_steering_deg", "deg")],
        ),
    ]
    return _issues(deltas, "CORNER_ENTRY", (d("ref_turn_in_progress") + d("ref_apex_progress")) / 2, rules, least)


def exit_issues(deltas: DataFrame, least: float = LEAST_LOSS, point: float = 0.01, later_seconds: float = 0.15, speed_kmh: float = 3.0, throttle: float = 0.1, steering_deg: float = 3.0) -> DataFrame:
    d = F.col
    rules = [
        (
            "LATE_THROTTLE_APPLICATION", (d("throttle_application_progress_delta") >= point) | (d("time_to_throttle_seconds_delta") >= later_seconds),
            [_evidence("throttle_application_progress", "throttle_application_progress", "normalized_progress"), _evidence("time_to_throttle", "time_to_throttle_seconds", "s")],
        ),
        ("POOR_EXIT_SPEED", d("exit_speed_kmh_delta") <= -speed_kmh, [_evidence("exit_speed", "exit_speed_kmh", "km/h")]),
        ("LOW_EXIT_THROTTLE", d("throttle_at_exit_delta") <= -throttle, [_evidence("exit_throttle", "throttle_at_exit", "normalized")]),
        (
            "SLOW_STEERING_UNWIND", (d("abs_steering_at_exit_deg_delta") >= steering_deg) | (d("steering_unwind_deg_delta") <= -steering_deg),
            [_evidence("exit_steering", "abs_steering_at_exit_deg", "deg"), _evidence("steering_unwind", "steering_unwind_deg", "deg")],
        ),
    ]
    return _issues(deltas, "CORNER_EXIT", (d("ref_apex_progress") + d("ref_exit_progress")) / 2, rules, least)


def all_issues(zone_deltas: DataFrame, entry_deltas: DataFrame, exit_deltas: DataFrame) -> DataFrame:
    parts = [braking_issues(zone_deltas), entry_issues(entry_deltas), exit_issues(exit_deltas)]
    return reduce(DataFrame.unionByName, parts).drop("rank")


def corner_diagnosis(corners: DataFrame, balanced: float = 0.03) -> DataFrame:
    """Losses of each corner and the phase that loses the most."""
    entry, leave = F.col("entry_time_loss_seconds"), F.col("exit_time_loss_seconds")
    phase = F.when((entry <= 0) & (leave <= 0), "NONE").when(F.abs(entry - leave) <= balanced, "BALANCED").when(entry > leave, "ENTRY").otherwise("EXIT")
    return corners.select(
        *PAIR, F.col("ref_number").alias("corner_number"), "ref_start_progress", "ref_exit_progress", F.coalesce("time_lost_seconds", F.lit(0.0)).alias("time_lost_seconds"), F.coalesce("time_gained_seconds", F.lit(0.0)).alias("time_gained_seconds"),
        entry.alias("entry_time_loss_seconds"), leave.alias("exit_time_loss_seconds"), phase.alias("dominant_phase"), "minimum_speed_kmh_delta", "apex_speed_kmh_delta", "exit_speed_kmh_delta",
    )


def corner_issues(corners: DataFrame, issues: DataFrame, margin: float = 0.02) -> DataFrame:
    """Issues of each corner whose stretch, widened by ``margin``, holds their centre; an issue may belong to several."""
    joined = corner_diagnosis(corners).join(issues, list(PAIR)).where(F.col("center_progress").between(F.col("ref_start_progress") - margin, F.col("ref_exit_progress") + margin))
    order = Window.partitionBy(*PAIR, "corner_number").orderBy(_level("severity"), F.desc("time_loss_seconds"), "center_progress", "code")
    return joined.withColumn("rank", F.row_number().over(order))


def stray_issues(corners: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues that belong to no corner."""
    return issues.join(corner_issues(corners, issues), [*PAIR, "source", "code", "center_progress"], "left_anti")


#: Advice of each diagnostic: source, code, type, phase (fixed values)
TEMPLATES = (
    ("BRAKING", "BRAKING_TOO_EARLY", "braking_point", "ENTRY"),
    ("BRAKING", "BRAKING_TOO_LATE", "braking_point", "ENTRY"),
    ("BRAKING", "OVER_SLOWING", "minimum_speed", "ENTRY"),
    ("BRAKING", "LATE_BRAKE_RELEASE", "brake_release", "ENTRY"),
    ("BRAKING", "EXCESSIVE_BRAKE_PRESSURE", "brake_pressure", "ENTRY"),
    ("CORNER_ENTRY", "EARLY_TURN_IN", "turn_in", "ENTRY"),
    ("CORNER_ENTRY", "LATE_TURN_IN", "turn_in", "ENTRY"),
    ("CORNER_ENTRY", "ENTRY_OVER_SLOWING", "minimum_speed", "ENTRY"),
    ("CORNER_ENTRY", "EXCESSIVE_TRAIL_BRAKING", "trail_braking", "ENTRY"),
    ("CORNER_ENTRY", "EXCESSIVE_STEERING", "steering_input", "ENTRY"),
    ("CORNER_ENTRY", "POOR_APEX_SPEED", "apex_speed", "ENTRY"),
    ("CORNER_EXIT", "LATE_THROTTLE_APPLICATION", "throttle_application", "EXIT"),
    ("CORNER_EXIT", "POOR_EXIT_SPEED", "exit_speed", "EXIT"),
    ("CORNER_EXIT", "LOW_EXIT_THROTTLE", "throttle_application", "EXIT"),
    ("CORNER_EXIT", "SLOW_STEERING_UNWIND", "steering_unwind", "EXIT"),
)


def templates(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(TEMPLATES), "source string, code string, recommendation_type string, phase string")


def advice(corner_issues: DataFrame, least: float = LEAST_LOSS) -> DataFrame:
    """Advice for the issues of corners that lose ``least`` seconds or more, numbered within each pair; the order of equal ones is that of the corner's issues. Unknown codes give none."""
    known = F.broadcast(templates(corner_issues))  # fifteen rows
    rows = corner_issues.where(F.col("time_lost_seconds") >= least).join(known, ["source", "code"])
    order = Window.partitionBy(*PAIR).orderBy("corner_number", "phase", "source", "code", "rank")
    return rows.withColumn("priority", F.col("severity")).withColumn("advice_number", F.row_number().over(order)).drop("rank")


def unknown_codes(corner_issues: DataFrame, least: float = LEAST_LOSS) -> DataFrame:
    rows = corner_issues.where(F.col("time_lost_seconds") >= least).join(F.broadcast(templates(corner_issues)), ["source", "code"], "left_anti")
    return rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("unmapped_issue_count"))


def coaching_plan(advice: DataFrame, per_corner: int = 2, overall: int = 3) -> DataFrame:
    """Up to ``overall`` focuses of each pair: the best advice per corner and type, ``per_corner`` at most, by impact."""
    weight = F.when(F.col("priority") == "HIGH", 3.0).when(F.col("priority") == "MEDIUM", 2.0).otherwise(1.0)
    impact = F.greatest(F.lit(0.0), "time_lost_seconds") * 10.0 + F.greatest(F.lit(0.0), "time_loss_seconds") * 5.0 + weight
    scored = advice.withColumn("impact_score", impact)
    within = lambda *key: Window.partitionBy(*PAIR, *key)
    order = (F.desc("impact_score"), "corner_number", "phase", "recommendation_type")
    # of one type in a corner the first advice of the greatest impact; of equal impacts the lower corner, phase and type
    best = F.row_number().over(within("corner_number", "recommendation_type").orderBy(F.desc("impact_score"), "advice_number")) == 1
    for keep in (best, F.row_number().over(within("corner_number").orderBy(*order)) <= per_corner, F.row_number().over(within().orderBy(*order)) <= overall):
        scored = scored.withColumn("__keep", keep).where("__keep")
    out = scored.drop("__keep").withColumn("focus_rank", F.row_number().over(within().orderBy(*order)))
    return out.withColumn("level", F.when(F.col("focus_rank") == 1, "primary").when(F.col("focus_rank") == 2, "secondary").otherwise("optional"))


def report(pairs: DataFrame, corners: DataFrame, issues: DataFrame, advice: DataFrame, plan: DataFrame, neutral: float = 0.01) -> DataFrame:
    """One row for each pair: totals, trend, the worst corner, and how much advice was considered and chosen."""
    diagnosis = corner_diagnosis(corners)
    total = diagnosis.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("corner_count"), F.sum((F.col("time_lost_seconds") > 0).cast("int")).alias("corners_with_loss"), F.sum("time_lost_seconds").alias("total_time_lost_seconds"),
        F.sum("time_gained_seconds").alias("total_time_gained_seconds"), F.max_by(F.when(F.col("time_lost_seconds") > 0, F.col("corner_number")), F.struct("time_lost_seconds", (-F.col("corner_number")).alias("o"))).alias("primary_problem_corner"),
    )
    found = issues.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("issue_count"))
    considered = advice.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("considered"), F.countDistinct("corner_number").alias("affected_corners"))
    chosen = plan.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("focus_count"), F.max_by("recommendation_type", -F.col("focus_rank")).alias("primary_focus"))
    out = pairs
    for part in (total, found, considered, chosen):
        out = out.join(part, list(PAIR), "left")
    counts = ("corner_count", "corners_with_loss", "issue_count", "considered", "affected_corners", "focus_count")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in counts} | {c: F.coalesce(c, F.lit(0.0)) for c in ("total_time_lost_seconds", "total_time_gained_seconds")})
    net = F.col("total_time_lost_seconds") - F.col("total_time_gained_seconds")
    trend = F.when(net > neutral, "LOSING_TIME").when(net < -neutral, "GAINING_TIME").otherwise("NEUTRAL")
    return out.withColumns({"net_delta_seconds": net, "trend": trend, "suppressed": F.col("considered") - F.col("focus_count")})
