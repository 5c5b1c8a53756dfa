"""SQL of the lap-pair chain: matching, deltas, issues, advice, coaching plan and report.

The greedy matching folds each pair's sorted candidates in a list, in the order in which the rule takes them.
"""

from __future__ import annotations

from paddock.operators import matching, rules

PAIR = "session_id, ref_lap, target_lap"
_KEYS = PAIR.split(", ")
_POINTS = (
    "pts AS MATERIALIZED (SELECT session_id, ref_lap, target_lap, grid_index, progress, d, lag(progress) OVER w AS px, lag(d) OVER w AS pd "
    f"FROM (SELECT *, target_elapsed_seconds - ref_elapsed_seconds AS d FROM aligned) WINDOW w AS (PARTITION BY {PAIR} ORDER BY grid_index))"
)


def _span(low: str, high: str) -> tuple[str, str]:
    """(overlap, ratio) of two intervals."""
    overlap = f"greatest(0e0, least(r.{high}, q.{high}) - greatest(r.{low}, q.{low}))"
    span = f"least(greatest(0e0, r.{high} - r.{low}), greatest(0e0, q.{high} - q.{low}))"
    return overlap, f"CASE WHEN {overlap} > 0 AND {span} > 0 THEN {overlap} / {span} ELSE 0e0 END"


def _matched(name: str, part: str, number: str, fields: tuple[str, ...], center: str, span: tuple[str, str] | None, probes: dict[str, str], changes: dict[str, tuple[str, str]]) -> str:
    """CTEs <name>_cand, <name>_match and <name>_delta."""
    at = lambda side: center.format(s=side)
    distance = f"abs({at('q')} - {at('r')})"
    columns = ", ".join(f"r.{f} AS ref_{f}, q.{f} AS target_{f}" for f in fields)
    if span:
        overlap, ratio = _span(*span)
        columns += f", {overlap} AS overlap_progress, {ratio} AS overlap_ratio"
        near, score = f"({ratio} >= 0.2e0 OR {distance} <= 0.05e0)", f"'a': CASE WHEN {ratio} < 0.2e0 THEN 1 ELSE 0 END, 'b': {distance}, 'c': -({ratio})"
    else:
        near, score = f"{distance} <= 0.05e0", f"'b': {distance}"
    candidate = (
        f"{name}_cand AS MATERIALIZED (SELECT {', '.join('p.' + k for k in _KEYS)}, r.{number} AS ref_number, q.{number} AS target_number, {columns}, "
        f"{{'place': {at('r')}, 'ref': r.{number}, {score}, 'target': q.{number}}} AS entry "
        f"FROM pairs p JOIN {part} r ON r.session_id = p.session_id AND r.lap_number = p.ref_lap JOIN {part} q ON q.session_id = p.session_id AND q.lap_number = p.target_lap WHERE {near})"
    )
    fold = (
        "list_reduce(list_transform(list_sort(list(entry)), lambda x: {'m': [{'r': x.ref, 't': x.target}]}), "
        "lambda done, x: CASE WHEN len(list_filter(done.m, lambda y: y.r = x.m[1].r OR y.t = x.m[1].t)) > 0 THEN done ELSE {'m': list_concat(done.m, x.m)} END)"
    )
    match = f"{name}_match AS MATERIALIZED (SELECT {PAIR}, z.r AS ref_number, z.t AS target_number FROM (SELECT {PAIR}, unnest(({fold}).m) AS z FROM {name}_cand GROUP BY {PAIR}))"
    joins = " ".join(
        f"ASOF LEFT JOIN pts {k} ON {' AND '.join(f'{k}.{c} = c.{c}' for c in _KEYS)} AND {k}.progress >= c.ref_{f}" for k, f in probes.items()
    )
    value = lambda k: f"CASE WHEN {k}.progress = c.ref_{probes[k]} THEN {k}.d ELSE {k}.pd + ({k}.d - {k}.pd) * ((c.ref_{probes[k]} - {k}.px) / ({k}.progress - {k}.px)) END"
    deltas = ", ".join(f"target_{f} - ref_{f} AS {f}_delta" for f in fields)
    changed = ", ".join(f"({value(b)}) - ({value(a)}) AS {n}" for n, (a, b) in changes.items())
    change = "time_delta_change_seconds"
    delta = (
        f"{name}_delta AS MATERIALIZED (SELECT *, CASE WHEN {change} IS NOT NULL THEN greatest(0e0, {change}) END AS time_lost_seconds, CASE "
        f"WHEN {change} IS NOT NULL THEN greatest(0e0, -{change}) END AS time_gained_seconds "
        f"FROM (SELECT c.* EXCLUDE (entry), {deltas}, {changed} FROM {name}_cand c SEMI "
        f"JOIN {name}_match m ON {' AND '.join(f'm.{k} = c.{k}' for k in (*_KEYS, 'ref_number', 'target_number'))} {joins}))"
    )
    return f"{candidate}, {match}, {delta}"


_CHANGE = {"time_delta_change_seconds": ("a", "b")}
MATCHES = {
    "zone": _matched("zone", "zones", "zone_number", matching.ZONE, "{s}.center_progress", ("start_progress", "end_progress"), {"a": "start_progress", "b": "end_progress"}, _CHANGE),
    "entry": _matched(
        "entry", "entries", "entry_number", matching.ENTRY, "({s}.turn_in_progress + {s}.apex_progress) / 2", ("turn_in_progress", "apex_progress"), {"a": "turn_in_progress", "b": "apex_progress"}, _CHANGE
    ),
    "exit": _matched("exit", "exits", "exit_number", matching.EXIT, "{s}.apex_progress", None, {"a": "apex_progress", "b": "exit_progress"}, _CHANGE),
    "corner": _matched(
        "corner", "corners", "corner_number", matching.CORNER, "{s}.apex_progress", None, {"a": "start_progress", "b": "apex_progress", "k": "exit_progress"},
        {"time_to_apex_change_seconds": ("a", "b"), "exit_time_change_seconds": ("b", "k"), "time_delta_change_seconds": ("a", "k")},
    ),
}
FIELDS = {"zone": matching.ZONE, "entry": matching.ENTRY, "exit": matching.EXIT, "corner": matching.CORNER}
LOSSES = (
    "SELECT *, greatest(0e0, coalesce(time_to_apex_change_seconds, 0e0)) AS entry_time_loss_seconds, greatest(0e0, coalesce(exit_time_change_seconds, "
    "0e0)) AS exit_time_loss_seconds FROM corner_delta"
)


def doubles(kind: str) -> str:
    """Names of the double columns of a kind's deltas."""
    found = [c for f in FIELDS[kind] for c in (f"ref_{f}", f"target_{f}", f"{f}_delta")] + ["time_delta_change_seconds", "time_lost_seconds", "time_gained_seconds"]
    if kind in ("zone", "entry"):
        found += ["overlap_progress", "overlap_ratio"]
    if kind == "corner":
        found += ["time_to_apex_change_seconds", "exit_time_change_seconds", "entry_time_loss_seconds", "exit_time_loss_seconds"]
    return " ".join(found)


#: Source, centre, and of each rule the code, the condition, the first evidence's name and field, and how many there are
ISSUES = {
    "zone": ("BRAKING", "ref_center_progress", [
        ("BRAKING_TOO_EARLY", "start_progress_delta <= -0.01e0", "braking_start_progress", "start_progress", 1),
        ("BRAKING_TOO_LATE", "start_progress_delta >= 0.01e0", "braking_start_progress", "start_progress", 1),
        ("OVER_SLOWING", "minimum_speed_kmh_delta <= -3e0", "minimum_speed", "minimum_speed_kmh", 1),
        ("LATE_BRAKE_RELEASE", "end_progress_delta >= 0.01e0 AND duration_seconds_delta >= 0.1e0", "brake_release_progress", "end_progress", 2),
        ("EXCESSIVE_BRAKE_PRESSURE", "mean_brake_delta >= 0.08e0 OR peak_brake_delta >= 0.08e0", "average_brake", "mean_brake", 2),
    ]),
    "entry": ("CORNER_ENTRY", "(ref_turn_in_progress + ref_apex_progress) / 2", [
        ("EARLY_TURN_IN", "turn_in_progress_delta <= -0.01e0", "turn_in_progress", "turn_in_progress", 1),
        ("LATE_TURN_IN", "turn_in_progress_delta >= 0.01e0", "turn_in_progress", "turn_in_progress", 1),
        ("ENTRY_OVER_SLOWING", "speed_loss_kmh_delta >= 3e0", "entry_speed_loss", "speed_loss_kmh", 1),
        ("POOR_APEX_SPEED", "apex_speed_kmh_delta <= -3e0", "apex_speed", "apex_speed_kmh", 1),
        ("EXCESSIVE_TRAIL_BRAKING", "brake_overlap_seconds_delta >= 0.15e0 AND brake_at_turn_in_delta >= 0.08e0", "brake_overlap", "brake_overlap_seconds", 2),
        ("EXCESSIVE_STEERING", "maximum_abs_steering_deg_delta >= 3e0 OR average_abs_steering_deg_delta >= 2e0", "maximum_steering", "maximum_abs_steering_deg", 2),
    ]),
    "exit": ("CORNER_EXIT", "(ref_apex_progress + ref_exit_progress) / 2", [
        ("LATE_THROTTLE_APPLICATION", "throttle_application_progress_delta >= 0.01e0 OR time_to_throttle_seconds_delta >= 0.15e0", "throttle_application_progress", "throttle_application_progress", 2),
        ("POOR_EXIT_SPEED", "exit_speed_kmh_delta <= -3e0", "exit_speed", "exit_speed_kmh", 1),
        ("LOW_EXIT_THROTTLE", "throttle_at_exit_delta <= -0.1e0", "exit_throttle", "throttle_at_exit", 1),
        ("SLOW_STEERING_UNWIND", "abs_steering_at_exit_deg_delta >= 3e0 OR steering_unwind_deg_delta <= -3e0", "exit_steering", "abs_steering_at_exit_deg", 2),
    ]),
}


def _issues(kind: str) -> str:
    source, center, found = ISSUES[kind]
    return f"{kind}_issue AS (" + " UNION ALL ".join(
        f"SELECT {PAIR}, '{source}' AS source, '{code}' AS code, {center} AS center_progress, CASE WHEN time_lost_seconds >= 0.4e0 THEN 'HIGH' "
        "WHEN time_lost_seconds >= 0.15e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
        f"time_lost_seconds AS time_loss_seconds, ref_number AS reference_number, {n} AS evidence_count, '{metric}' AS metric, ref_{field} AS reference_value, "
        f"target_{field} AS target_value FROM {kind}_delta WHERE time_lost_seconds >= 0.05e0 AND ({condition})"
        for code, condition, metric, field, n in found
    ) + ")"


ISSUE_DOUBLES = "center_progress time_loss_seconds reference_value target_value"
CORNER_ISSUE_DOUBLES = (
    f"{ISSUE_DOUBLES} ref_start_progress ref_exit_progress time_lost_seconds time_gained_seconds entry_time_loss_seconds exit_time_loss_seconds minimum_speed_kmh_delta apex_speed_kmh_delta exit_speed_kmh_delta"
)


def ranked(kind: str) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {PAIR} ORDER BY time_loss_seconds DESC, center_progress, code) AS INTEGER) AS rank FROM {kind}_issue"


_LEVEL = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"
_DIAGNOSIS = (
    f"diagnosis AS (SELECT {PAIR}, ref_number AS corner_number, ref_start_progress, ref_exit_progress, coalesce(time_lost_seconds, 0e0) "
    "AS time_lost_seconds, coalesce(time_gained_seconds, 0e0) AS time_gained_seconds, entry_time_loss_seconds, exit_time_loss_seconds, "
    "CASE WHEN entry_time_loss_seconds <= 0 AND exit_time_loss_seconds <= 0 THEN 'NONE' "
    "WHEN abs(entry_time_loss_seconds - exit_time_loss_seconds) <= 0.03e0 THEN 'BALANCED' "
    "WHEN entry_time_loss_seconds > exit_time_loss_seconds THEN 'ENTRY' ELSE 'EXIT' END AS dominant_phase, "
    f"minimum_speed_kmh_delta, apex_speed_kmh_delta, exit_speed_kmh_delta FROM ({LOSSES}))"
)
_CORNER_ISSUES = (
    f"corner_issues AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY {PAIR}, corner_number "
    f"ORDER BY {_LEVEL}, time_loss_seconds DESC, center_progress, code) AS INTEGER) AS rank "
    f"FROM diagnosis JOIN issues USING ({PAIR}) WHERE center_progress BETWEEN ref_start_progress - 0.02e0 AND ref_exit_progress + 0.02e0)"
)
_TEMPLATES = "templates(source, code, recommendation_type, phase) AS (VALUES " + ", ".join(str(t) for t in rules.TEMPLATES) + ")"
_ADVICE = (
    f"advice AS MATERIALIZED (SELECT * EXCLUDE (rank), severity AS priority, CAST(row_number() OVER (PARTITION BY {PAIR} "
    "ORDER BY corner_number, phase, source, code, rank) AS INTEGER) AS advice_number "
    "FROM corner_issues JOIN templates USING (source, code) WHERE time_lost_seconds >= 0.05e0)"
)
_BY = "impact_score DESC, corner_number, phase, recommendation_type"
_PLAN = (
    "scored AS (SELECT *, greatest(0e0, time_lost_seconds) * 10e0 + greatest(0e0, time_loss_seconds) * 5e0 + CASE priority WHEN 'HIGH' THEN 3e0 "
    "WHEN 'MEDIUM' THEN 2e0 ELSE 1e0 END AS impact_score FROM advice), "
    f"best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY {PAIR}, corner_number, recommendation_type ORDER BY impact_score DESC, advice_number) = 1), "
    f"few AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY {PAIR}, corner_number ORDER BY {_BY}) <= 2), "
    "plan AS MATERIALIZED (SELECT *, CASE focus_rank WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' ELSE 'optional' END AS level "
    f"FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {PAIR} ORDER BY {_BY}) AS INTEGER) AS focus_rank FROM few) WHERE focus_rank <= 3)"
)
REPORT = (
    "SELECT *, total_time_lost_seconds - total_time_gained_seconds AS net_delta_seconds, CASE "
    "WHEN total_time_lost_seconds - total_time_gained_seconds > 0.01e0 THEN 'LOSING_TIME' "
    "WHEN total_time_lost_seconds - total_time_gained_seconds < -0.01e0 THEN 'GAINING_TIME' "
    "ELSE 'NEUTRAL' END AS trend, considered - focus_count AS suppressed FROM ("
    f"SELECT {PAIR}, coalesce(corner_count, 0) AS corner_count, coalesce(corners_with_loss, 0) AS corners_with_loss, coalesce(lost, 0e0) "
    "AS total_time_lost_seconds, coalesce(gained, 0e0) AS total_time_gained_seconds, primary_problem_corner, coalesce(issue_count, 0) AS issue_count, "
    "coalesce(considered, 0) AS considered, coalesce(affected_corners, 0) AS affected_corners, coalesce(focus_count, 0) AS focus_count, primary_focus FROM pairs "
    "LEFT JOIN (SELECT session_id, ref_lap, target_lap, count(*) AS corner_count, CAST(count(*) FILTER (time_lost_seconds > 0) AS BIGINT) "
    "AS corners_with_loss, sum(time_lost_seconds) AS lost, sum(time_gained_seconds) AS gained, "
    "first(corner_number ORDER BY time_lost_seconds DESC, corner_number) FILTER (time_lost_seconds > 0) AS primary_problem_corner FROM diagnosis "
    f"GROUP BY {PAIR}) USING ({PAIR}) LEFT JOIN (SELECT {PAIR}, count(*) AS issue_count FROM issues GROUP BY {PAIR}) USING ({PAIR}) "
    f"LEFT JOIN (SELECT {PAIR}, count(*) AS considered, count(DISTINCT corner_number) AS affected_corners FROM advice GROUP BY {PAIR}) USING ({PAIR}) LEFT "
    f"JOIN (SELECT {PAIR}, count(*) AS focus_count, arg_min(recommendation_type, focus_rank) AS primary_focus FROM plan GROUP BY {PAIR}) USING ({PAIR}))"
)


def chain(parts: str) -> str:
    """WITH all stages; ``parts`` is the WITH of pairs, alignment, zones, entries, exits and corners."""
    return ", ".join((
        parts, _POINTS, *MATCHES.values(), *map(_issues, ISSUES), "issues AS MATERIALIZED (SELECT * FROM zone_issue UNION ALL SELECT * FROM entry_issue UNION ALL SELECT * FROM exit_issue)",
        _DIAGNOSIS, _CORNER_ISSUES, _TEMPLATES, _ADVICE, _PLAN,
    ))


def unmatched(kind: str, part: str) -> str:
    sides = [
        f"SELECT {PAIR}, '{side}' AS side, {kind}_number AS number FROM pairs p JOIN {part} x ON x.session_id = p.session_id AND x.lap_number = p.{side}_lap ANTI JOIN {kind}_match m "
        f"ON {' AND '.join(f'm.{k} = p.{k}' for k in _KEYS)} AND m.{side}_number = x.{kind}_number"
        for side in ("ref", "target")
    ]
    return " UNION ALL ".join(s.replace(f"SELECT {PAIR}", "SELECT " + ", ".join("p." + k for k in _KEYS), 1) for s in sides)
