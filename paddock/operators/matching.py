"""Zones, entries, exits and corners of one lap matched to another's, and their deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.traces import PAIR

ZONE = ("start_progress", "end_progress", "center_progress", "duration_seconds", "entry_speed_kmh", "minimum_speed_kmh", "exit_speed_kmh", "peak_brake", "mean_brake")
ENTRY = (
    "turn_in_progress", "apex_progress", "entry_duration_seconds", "brake_overlap_seconds", "entry_speed_kmh", "apex_speed_kmh", "speed_loss_kmh", "brake_at_turn_in",
    "throttle_at_turn_in", "throttle_at_apex", "maximum_abs_steering_deg", "average_abs_steering_deg",
)
EXIT = (
    "apex_progress", "exit_progress", "throttle_application_progress", "duration_seconds", "time_to_throttle_seconds", "apex_speed_kmh", "exit_speed_kmh", "speed_gain_kmh",
    "throttle_at_exit", "abs_steering_at_exit_deg", "steering_unwind_deg",
)
CORNER = (
    "start_progress", "turn_in_progress", "apex_progress", "throttle_application_progress", "exit_progress", "minimum_speed_kmh", "apex_speed_kmh", "exit_speed_kmh", "total_duration_seconds",
)


def _sides(pairs: DataFrame, parts: DataFrame, number: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    def side(name: str) -> DataFrame:
        return pairs.join(parts.select("session_id", F.col("lap_number").alias(f"{name}_lap"), F.col(number).alias(f"{name}_number"), *(F.col(f).alias(f"{name}_{f}") for f in fields)), ["session_id", f"{name}_lap"])

    return side("ref"), side("target")


def greedy(candidates: DataFrame, place: Column, score: list[Column]) -> DataFrame:
    """One to one matches of each pair: references in order of ``place`` take the free target with the least ``score``, earlier ones on ties.

    The lists are those of one pair of laps, tens of rows, and are folded in one expression.
    """
    entry = F.struct(place.alias("place"), F.col("ref_number"), *(s.alias(f"s{i}") for i, s in enumerate(score)), F.col("target_number"))
    lists = candidates.groupBy(*PAIR).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    start = F.struct(F.array().cast("array<int>").alias("refs"), F.array().cast("array<int>").alias("targets"))

    def step(done: Column, c: Column) -> Column:
        taken = F.array_contains(done["refs"], c["ref_number"]) | F.array_contains(done["targets"], c["target_number"])
        return F.when(taken, done).otherwise(F.struct(F.concat(done["refs"], F.array(c["ref_number"])).alias("refs"), F.concat(done["targets"], F.array(c["target_number"])).alias("targets")))

    matched = lists.select(*PAIR, F.aggregate("c", start, step).alias("m"))
    zipped = F.zip_with("m.refs", "m.targets", lambda r, t: F.struct(r.alias("ref_number"), t.alias("target_number")))
    return matched.select(*PAIR, F.explode(zipped).alias("z")).select(*PAIR, "z.ref_number", "z.target_number")


def _span_candidates(ref: DataFrame, target: DataFrame, low: str, high: str, center: tuple[Column, Column], overlap_ratio: float, distance: float) -> tuple[DataFrame, Column, list[Column]]:
    both = ref.join(target, list(PAIR))
    overlap = F.greatest(F.lit(0.0), F.least(f"ref_{high}", f"target_{high}") - F.greatest(f"ref_{low}", f"target_{low}"))
    span = F.least(F.greatest(F.lit(0.0), F.col(f"ref_{high}") - F.col(f"ref_{low}")), F.greatest(F.lit(0.0), F.col(f"target_{high}") - F.col(f"target_{low}")))
    both = both.withColumns({"overlap_progress": overlap, "overlap_ratio": F.when((overlap > 0) & (span > 0), overlap / span).otherwise(0.0), "__distance": F.abs(center[1] - center[0])})
    near = both.where((F.col("overlap_ratio") >= overlap_ratio) | (F.col("__distance") <= distance))
    return near, center[0], [(F.col("overlap_ratio") < overlap_ratio).cast("int"), F.col("__distance"), -F.col("overlap_ratio")]


#: Fields of the parts of reference laps at which their deltas need the time delta, of zones, entries, exits and corners
ZONE_PLACES, ENTRY_PLACES, EXIT_PLACES = ("start_progress", "end_progress"), ("turn_in_progress", "apex_progress"), ("apex_progress", "exit_progress")
CORNER_PLACES = ("start_progress", "apex_progress", "exit_progress")


def places(pairs: DataFrame, parts: list[tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """Where on the reference laps of ``pairs`` the time deltas of their ``parts`` (each with its fields) are needed: PAIR and position."""
    each = [df.select("session_id", F.col("lap_number").alias("ref_lap"), F.explode(F.array(*fields)).alias("position")) for df, fields in parts]
    return pairs.select(*PAIR).join(reduce(DataFrame.unionByName, each).distinct(), ["session_id", "ref_lap"])


def _deltas(candidates: DataFrame, matches: DataFrame, times: DataFrame, fields: tuple[str, ...], probes: dict[str, str], changes: dict[str, tuple[str, str]]) -> DataFrame:
    """Matched rows with target minus reference of ``fields``, time deltas (``times``) at reference positions (``probes``: name to field) and their differences.

    A pair's time deltas, tens of them, meet its rows as one map.
    """
    out = candidates.join(matches, [*PAIR, "ref_number", "target_number"]).withColumns({f"{f}_delta": F.col(f"target_{f}") - F.col(f"ref_{f}") for f in fields}).drop("__distance")
    known = times.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct("position", "time_delta_seconds"))).alias("__times"))
    out = out.join(known, list(PAIR), "left")
    out = out.withColumns({name: F.try_element_at("__times", F.col(f"ref_{field}")) for name, field in probes.items()}).drop("__times")
    change = {n: F.col(b) - F.col(a) for n, (a, b) in changes.items()}
    return out.withColumns(change).drop(*probes)


def _lost(df: DataFrame, change: str = "time_delta_change_seconds") -> DataFrame:
    """Seconds lost and gained; null where the change is."""
    known = F.col(change).isNotNull()
    return df.withColumns({"time_lost_seconds": F.when(known, F.greatest(F.lit(0.0), F.col(change))), "time_gained_seconds": F.when(known, F.greatest(F.lit(0.0), -F.col(change)))})


def match_zones(pairs: DataFrame, zones: DataFrame, overlap_ratio: float = 0.2, distance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches) of braking zones that overlap or lie close."""
    ref, target = _sides(pairs, zones, "zone_number", ZONE)
    near, place, score = _span_candidates(ref, target, "start_progress", "end_progress", (F.col("ref_center_progress"), F.col("target_center_progress")), overlap_ratio, distance)
    return near, greedy(near, place, score)


def zone_deltas(pairs: DataFrame, zones: DataFrame, times: DataFrame) -> DataFrame:
    near, found = match_zones(pairs, zones)
    return _lost(_deltas(near, found, times, ZONE, dict(zip(("__a", "__b"), ZONE_PLACES, strict=True)), {"time_delta_change_seconds": ("__a", "__b")}))


def match_entries(pairs: DataFrame, entries: DataFrame, overlap_ratio: float = 0.2, distance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    ref, target = _sides(pairs, entries, "entry_number", ENTRY)
    center = tuple((F.col(f"{n}_turn_in_progress") + F.col(f"{n}_apex_progress")) / 2 for n in ("ref", "target"))
    near, place, score = _span_candidates(ref, target, "turn_in_progress", "apex_progress", center, overlap_ratio, distance)
    return near, greedy(near, place, score)


def entry_deltas(pairs: DataFrame, entries: DataFrame, times: DataFrame) -> DataFrame:
    near, found = match_entries(pairs, entries)
    return _lost(_deltas(near, found, times, ENTRY, dict(zip(("__a", "__b"), ENTRY_PLACES, strict=True)), {"time_delta_change_seconds": ("__a", "__b")}))


def _match_apexes(pairs: DataFrame, parts: DataFrame, number: str, fields: tuple[str, ...], distance: float) -> tuple[DataFrame, DataFrame]:
    ref, target = _sides(pairs, parts, number, fields)
    near = ref.join(target, list(PAIR)).withColumn("__distance", F.abs(F.col("target_apex_progress") - F.col("ref_apex_progress"))).where(F.col("__distance") <= distance)
    return near, greedy(near, F.col("ref_apex_progress"), [F.col("__distance")])


def match_exits(pairs: DataFrame, exits: DataFrame, distance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    return _match_apexes(pairs, exits, "exit_number", EXIT, distance)


def match_corners(pairs: DataFrame, corners: DataFrame, distance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    return _match_apexes(pairs, corners, "corner_number", CORNER, distance)


def exit_deltas(pairs: DataFrame, exits: DataFrame, times: DataFrame, distance: float = 0.05) -> DataFrame:
    near, found = match_exits(pairs, exits, distance)
    return _lost(_deltas(near, found, times, EXIT, dict(zip(("__a", "__b"), EXIT_PLACES, strict=True)), {"time_delta_change_seconds": ("__a", "__b")}))


def corner_deltas(pairs: DataFrame, corners: DataFrame, times: DataFrame, distance: float = 0.05) -> DataFrame:
    """Matched corners with changes of the time delta to the apex, after it and in all."""
    near, found = match_corners(pairs, corners, distance)
    changes = {"time_to_apex_change_seconds": ("__a", "__b"), "exit_time_change_seconds": ("__b", "__c"), "time_delta_change_seconds": ("__a", "__c")}
    out = _lost(_deltas(near, found, times, CORNER, dict(zip(("__a", "__b", "__c"), CORNER_PLACES, strict=True)), changes))
    loss = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))
    return out.withColumns({"entry_time_loss_seconds": loss("time_to_apex_change_seconds"), "exit_time_loss_seconds": loss("exit_time_change_seconds")})


def unmatched(pairs: DataFrame, parts: DataFrame, number: str, matches: DataFrame) -> DataFrame:
    """Parts of either lap of a pair that have no partner."""
    ref, target = _sides(pairs, parts, number, ())
    rest = [s.join(matches, [*PAIR, f"{n}_number"], "left_anti").select(*PAIR, F.lit(n).alias("side"), F.col(f"{n}_number").alias("number")) for n, s in (("ref", ref), ("target", target))]
    return rest[0].unionByName(rest[1])
