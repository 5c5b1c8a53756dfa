"""Small hand-made inputs with known results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.functions import scalars, versions
from paddock.operators import events, laps, learn, matching, parity, quality, rules, sessions, setups, traces, zones
from paddock.schemas import WHEEL_FIELDS
from paddock.sources import frames, kafka, tables
from paddock.sources import traces as trace_files


def trace(spark, rows, columns):
    defaults = {"session_id": "s", "lap_number": 1, "car_id": "c", "track_id": "t", "throttle": 0.0, "brake": 0.0, "steering_angle_deg": 0.0, "gear": 3, "clutch": 0.0}
    made = [defaults | dict(zip(columns, r, strict=True)) | {"sample_index": i} for i, r in enumerate(rows)]
    names = list(made[0])
    kinds = {"session_id": "string", "car_id": "string", "track_id": "string", "lap_number": "int", "sample_index": "int", "gear": "int"}
    return spark.createDataFrame([tuple(float(m[n]) if kinds.get(n, "double") == "double" else m[n] for n in names) for m in made], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))


BRAKING = [(0, 0, 150, 0), (0.10, 10, 160, 0), (0.20, 20, 155, 0.2), (0.22, 21, 140, 0.7), (0.24, 22, 120, 1), (0.26, 23, 100, 0.5), (0.28, 24, 95, 0), (0.50, 50, 170, 0), (0.60, 60, 165, 0.3), (0.62, 61, 145, 0.8), (0.64, 62, 130, 0.4), (0.66, 63, 125, 0), (1, 100, 155, 0)]
CORNER = [
    (0.10, 10, 170, 1, 0, 0), (0.20, 20, 165, 0, 0.2, 0), (0.22, 21, 150, 0, 0.8, 2), (0.24, 22, 135, 0, 0.7, 6), (0.26, 24, 120, 0, 0.4, 12), (0.28, 26, 105, 0, 0, 18), (0.30, 28, 100, 0.1, 0, 20), (0.32, 30, 105, 0.3, 0, 18), (0.40, 40, 150, 1, 0, 0),
    (0.60, 60, 170, 0, 0.3, 0), (0.62, 61, 155, 0, 0.8, -7), (0.64, 63, 135, 0, 0.3, -14), (0.66, 65, 120, 0, 0, -19), (0.68, 67, 115, 0.1, 0, -21), (0.70, 69, 120, 0.3, 0, -18), (0.80, 80, 160, 1, 0, 0),
]
P = ("progress", "elapsed_seconds", "speed_kmh")


def test_braking_zones(spark):
    t = trace(spark, BRAKING, (*P, "brake"))
    found = zones.braking_zones(t).orderBy("zone_number").collect()
    assert len(found) == 2
    z = found[0]
    assert (z.start_progress, z.end_progress, z.entry_speed_kmh, z.minimum_speed_kmh, z.exit_speed_kmh, z.peak_brake, z.sample_count) == (0.2, 0.26, 155, 100, 100, 1, 4)
    assert z.center_progress == pytest.approx(0.23) and z.duration_seconds == 3 and z.mean_brake == pytest.approx(0.6)
    one = zones.braking_zones(t, threshold=0.6).orderBy("zone_number").first()
    assert (one.start_progress, one.end_progress) == (0.22, 0.24)
    tap = trace(spark, [(0, 0, 100, 0), (0.1, 1, 90, 0.5), (0.2, 2, 95, 0)], (*P, "brake"))
    assert zones.braking_zones(tap).count() == 0
    assert zones.braking_zones(tap, minimum_samples=1).first().duration_seconds == 0


def test_corner_entries_and_exits(spark):
    t = trace(spark, CORNER, (*P, "throttle", "brake", "steering_angle_deg"))
    found = zones.corner_entries(t, zones.braking_zones(t)).orderBy("entry_number").collect()
    assert [(e.turn_in_progress, e.apex_progress, e.apex_speed_kmh) for e in found] == [(0.24, 0.30, 100), (0.62, 0.68, 115)]
    rows = [(0.30, 28, 100, 0.1, 20), (0.32, 29, 104, 0.2, 18), (0.34, 30, 110, 0.4, 14), (0.36, 31, 120, 0.7, 9), (0.38, 32, 132, 0.85, 6), (0.40, 33, 142, 1, 3)]
    entry = spark.createDataFrame([("s", 1, 1, 0.30)], "session_id string, lap_number int, entry_number int, apex_progress double")
    leave = zones.corner_exits(trace(spark, rows, (*P, "throttle", "steering_angle_deg")), entry).first()
    assert (leave.throttle_application_progress, leave.exit_progress, leave.steering_unwind_deg) == (0.32, 0.38, 14)


def test_alignment(spark):
    ref = trace(spark, [(0, 0, 100, 0, 0), (0.5, 50, 80, 1, 15), (1, 100, 120, 0, 0)], (*P, "brake", "steering_angle_deg"))
    target = trace(spark, [(0, 0, 100, 0, 0), (0.25, 25.5, 91, 0, 0), (0.5, 51, 74, 1, 17), (0.75, 76.5, 101, 0, 0), (1, 102, 120, 0, 0)], (*P, "brake", "steering_angle_deg")).withColumn("lap_number", F.lit(2))
    pairs = spark.createDataFrame([("s", 1, 2)], "session_id string, ref_lap int, target_lap int")
    rows = traces.align(pairs, ref.unionByName(target), 5).orderBy("grid_index").collect()
    assert len(rows) == 5 and rows[-1].time_delta_seconds == pytest.approx(2) and rows[2].speed_kmh_delta == pytest.approx(-6)
    assert rows[1].ref_elapsed_seconds == pytest.approx(25) and rows[2].steering_angle_deg_delta == pytest.approx(2)


def test_lap_history_and_comparison(spark):
    lap = spark.createDataFrame([("s", 1, 105000), ("s", 2, 104500)], "session_id string, lap_number int, lap_time_ms int")
    sector = spark.createDataFrame([("s", 1, 1, 34000), ("s", 1, 2, 38000), ("s", 1, 3, 33000), ("s", 2, 1, 33700), ("s", 2, 2, 38400), ("s", 2, 3, 32400)], "session_id string, lap_number int, sector_number int, sector_time_ms int")
    h = laps.history(lap, sector).first()
    assert (h.best_lap_number, h.theoretical_best_ms, h.potential_gain_ms, h.average_lap_time_ms, h.stddev_lap_time_ms) == (2, 33700 + 38000 + 32400, 400, 104750, 250)
    pairs = spark.createDataFrame([("s", 1, 2)], "session_id string, ref_lap int, target_lap int")
    c = laps.compare(pairs, lap, sector).first()
    assert (c.total_delta_ms, c.lost_ms, c.gained_ms, c.is_complete, c.biggest_loss_sector, c.biggest_gain_sector) == (-500, 400, 900, True, 2, 3)
    advice = laps.recommend(pairs, lap, sector).orderBy("rank").collect()
    assert [(a.code, a.priority) for a in advice] == [("primary_sector", "HIGH"), ("consolidate_gain", "LOW")]


def test_pace(spark):
    lap = spark.createDataFrame([("s", 3, 61000), ("s", 1, 62000), ("s", 2, 60000), ("s", 4, 0)], "session_id string, lap_number int, lap_time_ms int")
    p = laps.pace(lap).first()
    assert (p.best_lap_number, p.mean_ms, p.last_change_ms) == (2, 61000, 1000) and p.spread_ms == pytest.approx(816.49658)


def snapshots(spark, rows):
    columns = "arrival long, completed_laps long, progress double, ms long, last_time_ms long"
    df = spark.createDataFrame(rows, columns)
    fixed = {"source_id": 1, "packet_id": 0, "car_model": "c", "track": "t", "session_type": "race", "status": "LIVE", "best_time_ms": 0, "speed_kmh": 100.0, "throttle": 0.0, "brake": 0.0, "steering_angle_deg": 0.0}
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"elapsed_seconds": F.col("ms") / 1000, "packet_id": F.col("arrival")})


def test_lap_trace_extraction(spark):
    rows = [(0, 0, 0.01, 500, 0), (1, 0, 0.50, 50000, 0), (2, 0, 0.98, 99000, 0), (3, 1, 0.01, 500, 100000)]
    got = events.lap_traces(events.sessionize(snapshots(spark, rows))).orderBy("sample_index").collect()
    assert [(g.lap_number, g.lap_time_ms, g.progress) for g in got] == [(1, 100000, 0.01), (1, 100000, 0.5), (1, 100000, 0.98)]


def test_accepted_samples(spark):
    # a sample behind in progress must not raise the bar for elapsed time
    rows = [(0, 0, 0.01, 0, 0), (1, 0, 0.5, 5000, 0), (2, 0, 0.4, 10000, 0), (3, 0, 0.6, 7000, 0), (4, 0, 0.6, 8000, 0), (5, 0, 0.95, 9000, 0), (6, 1, 0.0, 0, 90000)]
    got = events.lap_traces(events.sessionize(snapshots(spark, rows))).orderBy("sample_index").collect()
    assert [(g.progress, g.elapsed_seconds) for g in got] == [(0.01, 0), (0.5, 5), (0.6, 8), (0.95, 9)]


def test_trace_quality(spark):
    a = trace(spark, [(0, 0, 1), (0.1, 1, 1), (0.8, 2, 1), (0.95, 3, 1)], P)
    b = trace(spark, [(0.2, 0, 1), (0.4, 1, 1), (1, 2, 1)], P).withColumn("lap_number", F.lit(2))
    q = traces.coverage(a).first()
    assert q.largest_gap == pytest.approx(0.7) and (q.gap_start, q.gap_end) == (0.1, 0.8)
    pairs = spark.createDataFrame([("s", 1, 2)], "session_id string, ref_lap int, target_lap int")
    s = traces.shared_coverage(pairs, a.unionByName(b)).first()
    assert (s.shared_start, s.shared_end) == (0.2, 0.95) and s.shared_span == pytest.approx(0.75)


def test_greedy_matching_equals_a_loop(spark):
    rng = random.Random(3)
    rows, expected = [], set()
    for pair in range(60):
        ref = sorted(rng.sample(range(100), rng.randint(0, 8)))
        target = sorted(rng.sample(range(100), rng.randint(0, 8)))
        free = list(enumerate(target))
        for i, r in enumerate(ref):
            near = [(abs(t - r), j, t) for j, t in free if abs(t - r) <= 12]
            rows += [(str(pair), 1, 2, i, j, float(r), float(abs(t - r))) for j, t in enumerate(target) if abs(t - r) <= 12]
            if near:
                _, j, t = min(near)
                free.remove((j, t))
                expected.add((str(pair), i, j))
    df = spark.createDataFrame(rows, "session_id string, ref_lap int, target_lap int, ref_number int, target_number int, place double, distance double")
    got = {(r.session_id, r.ref_number, r.target_number) for r in matching.greedy(df, F.col("place"), [F.col("distance")]).collect()}
    assert got == expected


def test_quality_flags_of_missing_values(spark):
    columns = sorted(set(quality.REQUIRED) - {"timestamp", "session_id", "car_id", "track_id"})
    good = dict.fromkeys(columns, 1.0) | {"environment_grip_level": 1.0}
    cases = [good, good | {"vehicle_throttle": None}, good | {"environment_grip_level": None}, good | {"vehicle_speed_kmh": float("nan")}, good | {"fl_pressure_psi": None}, good | {"vehicle_throttle": 1.5}, good | {"fl_pressure_psi": 0.0}]
    df = spark.createDataFrame([(i, *(c[k] for k in columns)) for i, c in enumerate(cases)], "i int, " + ", ".join(f"{k} double" for k in columns))
    df = df.withColumns({"timestamp": F.current_timestamp(), "session_id": F.lit("s"), "car_id": F.lit("c"), "track_id": F.lit("t")})
    got = [tuple(int(r[f]) for f in quality.FLAGS) for r in quality.with_flags(df).orderBy("i").collect()]
    assert got == [(0, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1)]


def test_fuel_by_time_not_index(spark):
    zero = {c: F.lit(0.0) for c in (*sessions._AVERAGES, *sessions._PEAKS, "vehicle_speed_kmh", "vehicle_rpm", "vehicle_throttle", "vehicle_brake", "vehicle_lateral_g", "vehicle_longitudinal_g", "elapsed_seconds")}
    df = spark.createDataFrame([(1, 2, 30.0), (2, 1, 29.0)], "t int, sample_index int, vehicle_fuel_l double").withColumns(zero | {"timestamp": F.timestamp_seconds("t"), "is_valid": F.lit(True)} | {c: F.lit("x") for c in ("session_id", "car_id", "track_id", "setup_id", "session_type", "telemetry_source")})
    assert sessions.gold_summary(df).first().fuel_used_l == 1.0
    assert len(sessions.gold_summary(df).columns) == 39


def test_fingerprint(spark):
    df = spark.range(12).select("id", (F.col("id") * 0.5).alias("x"))
    of = lambda d: parity.fingerprint(d).first().fingerprint
    base = of(df)
    assert of(df.orderBy(F.desc("id")).repartition(5)) == base
    others = [df.withColumnRenamed("x", "y"), df.union(df.limit(1)), df.withColumn("x", F.when(F.col("id") == 3, 9.0).otherwise(F.col("x"))), df.withColumn("x", F.when(F.col("id") != 3, F.col("x")))]
    assert len({base, *map(of, others)}) == 5
    assert parity.fingerprint(df.where("id < 0")).count() == 0


def test_distance_import(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, None, 36.0, 50.0, 20.0), ("a", 1, 100.0, None, 36.0, 50.0, 20.0), ("b", 0, 0.0, 0.0, 36.0, 0.5, 0.2), ("b", 1, 120.0, 12.0, 36.0, 0.5, 0.2)], "name string, sample_index int, lap_distance_m double, elapsed_seconds double, speed_kmh double, throttle double, brake double")
    got = trace_files.normalize_distance(rows).where("name = 'a' and sample_index = 1").first()
    assert got.elapsed_seconds == pytest.approx(10) and got.progress == pytest.approx(100 / 120) and (got.throttle, got.brake) == (0.5, 0.2)


def test_exchange_variants(spark):
    sample = '{"progress": 0.1, "elapsed_seconds": 1, "speed_kmh": 90}'
    texts = spark.createDataFrame([("bare", f"[{sample}]"), ("samples", f'{{"samples": [{sample}, {sample}]}}'), ("only", f'{{"lap": [{sample}]}}')], "name string, value string")
    assert {(r["name"], r["count"]) for r in trace_files.parse_exchange(texts).groupBy("name").count().collect()} == {("bare", 1), ("samples", 2), ("only", 1)}


def test_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z", "session_id": "s", "sample_index": 0}\n\nnot json\n')
    good, bad = frames.read_frames(spark, str(tmp_path))
    assert good.count() == 1 and bad.count() == 1 and frames.failed_sessions(bad).count() == 1


def test_kafka_errors(spark):
    value = '{"schema_version":%d,"source":%s,"session_type":"race","setup_id":null,"frame":{"session_id":"s"}}'
    rows = [(b"s", b"{broken", 0), (b"s", (value % (99, '"a"')).encode(), 1), (b"s", (value % (1, "null")).encode(), 2), (b"k", (value % (1, '"a"')).encode(), 3), (b"s", None, 4), (b"s", (value % (1, '"a"')).encode(), 5)]
    df = spark.createDataFrame([(k, v, "t", 0, o) for k, v, o in rows], "key binary, value binary, topic string, partition int, offset long")
    got = [r.decode_error for r in kafka.decode(df).orderBy("kafka_offset").collect()]
    assert got == ["invalid_json", "unsupported_schema", "invalid_metadata", "invalid_metadata", "invalid_json", None]


def test_kafka_metadata_and_times(spark):
    value = '{"schema_version":1,"source":%s,"session_type":"race","setup_id":null,"frame":{"timestamp":%s,"session_id":%s}}'
    made = [('" "', '"2024-01-01T00:00:00Z"', '"s"'), ('""', '"2024-01-01T00:00:00Z"', '"s"'), ('"a"', '"not a date"', '"s"'), ('"a"', "null", "null")]
    rows = [(None if i == 3 else b"s", (value % v).encode(), "t", 0, i) for i, v in enumerate(made)]
    got = kafka.decode(spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long")).orderBy("kafka_offset").collect()
    assert [r.decode_error for r in got] == [None, "invalid_metadata", None, "invalid_metadata"]
    assert [r.timestamp is None for r in got] == [False, False, True, True]
    with pytest.raises(Exception, match="invalid message"):
        kafka.checked(kafka.decode(spark.createDataFrame(rows[1:2], "key binary, value binary, topic string, partition int, offset long"))).collect()


DELTAS = {
    "braking": dict.fromkeys("center_progress start_progress end_progress minimum_speed_kmh duration_seconds mean_brake peak_brake".split(), (0.5, 0.5)),
    "entry": dict.fromkeys("turn_in_progress apex_progress speed_loss_kmh apex_speed_kmh brake_overlap_seconds brake_at_turn_in maximum_abs_steering_deg average_abs_steering_deg".split(), (0.5, 0.5)),
    "exit": dict.fromkeys("apex_progress exit_progress throttle_application_progress time_to_throttle_seconds exit_speed_kmh throttle_at_exit abs_steering_at_exit_deg steering_unwind_deg".split(), (0.5, 0.5)),
}


def deltas(spark, kind, rows):
    """Rows of one pair with a reference and a target value of each measure, equal but for those given as changes."""
    names = list(DELTAS[kind])
    made = [("s", 1, 2, i + 1, loss, *(0.5 for _ in names), *(0.5 + change.get(n, 0.0) for n in names), *(float(change.get(n, 0.0)) for n in names)) for i, (loss, change) in enumerate(rows)]
    columns = ["session_id string", "ref_lap int", "target_lap int", "ref_number int", "time_lost_seconds double", *(f"{p}{n}{q} double" for p, q in (("ref_", ""), ("target_", ""), ("", "_delta")) for n in names)]
    return spark.createDataFrame(made, ", ".join(columns))


def test_every_diagnostic_rule(spark):
    """Each rule fires at its threshold, none just below it or where too little time is lost."""
    cases = {
        "braking": (rules.braking_issues, [("BRAKING_TOO_EARLY", {"start_progress": -0.01}), ("BRAKING_TOO_LATE", {"start_progress": 0.01}), ("OVER_SLOWING", {"minimum_speed_kmh": -3}), ("LATE_BRAKE_RELEASE", {"end_progress": 0.01, "duration_seconds": 0.1}), ("EXCESSIVE_BRAKE_PRESSURE", {"mean_brake": 0.08}), ("EXCESSIVE_BRAKE_PRESSURE", {"peak_brake": 0.08})]),
        "entry": (rules.entry_issues, [("EARLY_TURN_IN", {"turn_in_progress": -0.01}), ("LATE_TURN_IN", {"turn_in_progress": 0.01}), ("ENTRY_OVER_SLOWING", {"speed_loss_kmh": 3}), ("POOR_APEX_SPEED", {"apex_speed_kmh": -3}), ("EXCESSIVE_TRAIL_BRAKING", {"brake_overlap_seconds": 0.15, "brake_at_turn_in": 0.08}), ("EXCESSIVE_STEERING", {"maximum_abs_steering_deg": 3}), ("EXCESSIVE_STEERING", {"average_abs_steering_deg": 2})]),
        "exit": (rules.exit_issues, [("LATE_THROTTLE_APPLICATION", {"throttle_application_progress": 0.01}), ("LATE_THROTTLE_APPLICATION", {"time_to_throttle_seconds": 0.15}), ("POOR_EXIT_SPEED", {"exit_speed_kmh": -3}), ("LOW_EXIT_THROTTLE", {"throttle_at_exit": -0.1}), ("SLOW_STEERING_UNWIND", {"abs_steering_at_exit_deg": 3}), ("SLOW_STEERING_UNWIND", {"steering_unwind_deg": -3})]),
    }
    for kind, (rule, wanted) in cases.items():
        fires = [(0.05, c) for _, c in wanted]
        below = [(0.05, {k: v * 0.99 for k, v in c.items()}) for _, c in wanted] + [(0.049, c) for _, c in wanted]
        got = sorted((r.reference_number, r.code) for r in rule(deltas(spark, kind, fires + below)).collect())
        assert got == [(i + 1, code) for i, (code, _) in enumerate(wanted)]
    half = deltas(spark, "entry", [(0.2, {"brake_overlap_seconds": 0.15})])
    assert rules.entry_issues(half).count() == 0  # trail braking needs both
    both = rules.braking_issues(deltas(spark, "braking", [(0.4, {"mean_brake": 0.1, "start_progress": -0.02}), (0.15, {"mean_brake": 0.1})])).orderBy("rank").collect()
    assert [(r.code, r.severity, r.rank) for r in both] == [("BRAKING_TOO_EARLY", "HIGH", 1), ("EXCESSIVE_BRAKE_PRESSURE", "HIGH", 2), ("EXCESSIVE_BRAKE_PRESSURE", "MEDIUM", 3)]


def test_coaching_plan_ties_and_caps(spark):
    """Equal impacts go by corner, phase and type; two focuses a corner and three in all; of one type in a corner the greatest impact."""
    issue = "source string, code string, severity string, corner_number int, time_lost_seconds double, time_loss_seconds double, rank int"
    rows = [
        ("BRAKING", "BRAKING_TOO_EARLY", "HIGH", 2, 0.5, 0.4, 1), ("BRAKING", "EXCESSIVE_BRAKE_PRESSURE", "HIGH", 2, 0.5, 0.4, 2), ("CORNER_EXIT", "POOR_EXIT_SPEED", "HIGH", 2, 0.5, 0.4, 3),
        ("CORNER_EXIT", "LATE_THROTTLE_APPLICATION", "LOW", 1, 0.2, 0.1, 1), ("CORNER_EXIT", "LOW_EXIT_THROTTLE", "MEDIUM", 1, 0.2, 0.1, 2), ("CORNER_ENTRY", "EARLY_TURN_IN", "MEDIUM", 1, 0.2, 0.1, 3),
        ("BRAKING", "OVER_SLOWING", "HIGH", 3, 0.04, 0.4, 1), ("BRAKING", "A_NEW_CODE", "HIGH", 2, 0.5, 0.4, 4),
    ]
    issues = spark.createDataFrame(rows, issue).withColumns({"session_id": F.lit("s"), "ref_lap": F.lit(1), "target_lap": F.lit(2), "center_progress": F.lit(0.5)})
    given = rules.advice(issues)
    assert [(a.corner_number, a.phase, a.code) for a in given.orderBy("advice_number").collect()] == [
        (1, "ENTRY", "EARLY_TURN_IN"), (1, "EXIT", "LATE_THROTTLE_APPLICATION"), (1, "EXIT", "LOW_EXIT_THROTTLE"),
        (2, "ENTRY", "BRAKING_TOO_EARLY"), (2, "ENTRY", "EXCESSIVE_BRAKE_PRESSURE"), (2, "EXIT", "POOR_EXIT_SPEED"),
    ]
    plan = rules.coaching_plan(given).orderBy("focus_rank").collect()
    assert [(p.corner_number, p.recommendation_type, p.level) for p in plan] == [(2, "brake_pressure", "primary"), (2, "braking_point", "secondary"), (1, "turn_in", "optional")]
    assert plan[0].impact_score == pytest.approx(0.5 * 10 + 0.4 * 5 + 3)
    assert rules.unknown_codes(issues).first().unmapped_issue_count == 1
    throttle = rules.coaching_plan(given.where("corner_number = 1")).where("recommendation_type = 'throttle_application'").first()
    assert throttle.code == "LOW_EXIT_THROTTLE"


def test_unmatched_parts(spark):
    pairs = spark.createDataFrame([("s", 1, 2)], "session_id string, ref_lap int, target_lap int")
    exits = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 2, 1)], "session_id string, lap_number int, exit_number int")
    matches = spark.createDataFrame([("s", 1, 2, 2, 1)], "session_id string, ref_lap int, target_lap int, ref_number int, target_number int")
    assert [tuple(r) for r in matching.unmatched(pairs, exits, "exit_number", matches).collect()] == [("s", 1, 2, "ref", 1)]


def test_silver_replaces_quarantine(spark, tmp_path):
    rows = lambda *items: spark.createDataFrame(list(items), "session_id string, sample_index int, timestamp int")
    none, path = rows(("x", 0, 0)).limit(0), str(tmp_path / "silver")
    frames.write_silver(spark, rows(("a/b c", 1, 1), ("b", 1, 1)), rows(("a/b c", 2, 2), ("b", 2, 2)), path)
    frames.write_silver(spark, rows(("a/b c", 1, 1), ("a/b c", 2, 2)), none, path)
    read = lambda t: sorted((r.session_id, r.sample_index) for r in versions.read(spark, path, t).collect())
    assert read("valid") == [("a/b c", 1), ("a/b c", 2), ("b", 1)] and read("quarantine") == [("b", 2)]


def test_wheels(spark):
    wheel = "struct(" + ", ".join(f"1.0D as {f}" for f in WHEEL_FIELDS) + ")"
    all_four = f"map('FL', {wheel}, 'FR', {wheel}, 'RL', {wheel}, 'RR', {wheel})"
    df = spark.sql(f"select 'good' as session_id, {all_four} as wheels union all select 'bad', map('FL', {wheel}) union all select 'bad', {all_four} union all select 'more', {all_four} union all select 'more', map_concat({all_four}, map('XX', {wheel}))")
    assert {tuple(r) for r in frames.wheel_problems(df).collect()} == {("bad", "missing_wheel"), ("more", "changing_wheels")}


def test_metadata_datasets_and_catalogs(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for i, n in enumerate((3, 0)):
        (tmp_path / "m" / f"{i}.metadata.json").write_text(f'{{\n"session_id": "s{i}", "sample_count": {n}, "duration_seconds": 1.5}}')
    assert [r.session_id for r in frames.read_metadata(spark, str(tmp_path / "m")).collect()] == ["s0"]
    data = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "a int, b double, c string")
    tables.write_csv(data, str(tmp_path / "d.csv"))
    assert [tuple(r) for r in tables.read_dataset(spark, str(tmp_path / "d.csv"), ("a", "b"), data.schema).collect()] == [(1, 2.0)]
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_dataset(spark, str(tmp_path / "d.csv"), ("a", "z"))
    tables.append_run(data, str(tmp_path / "runs"))
    tables.append_run(data.limit(1), str(tmp_path / "runs"))
    runs = tables.read_catalog(spark, str(tmp_path / "runs"), data.schema, multi_line=False)
    assert runs.count() == 3 and tables.get(runs, "a", 2).count() == 1
    with pytest.raises(KeyError):
        tables.get(runs, "a", 9)
    batch = spark.createDataFrame([("s", "c", "t"), ("s", "c", "t")], "session_id string, car_id string, track_id string")
    tables.publish(batch, str(tmp_path / "out"))
    for wrong in (batch.limit(0), batch.unionByName(batch.withColumn("car_id", F.lit("d")))):
        with pytest.raises(ValueError, match="one session"):
            tables.publish(wrong, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_exchange_is_checked(spark):
    texts = spark.createDataFrame([("ok", '{"format": "lap-trace", "version": 1, "samples": [{"progress": 0.1}]}'), ("other", '{"format": "x", "samples": [{"progress": 0.1}]}'), ("new", '{"version": 2, "samples": [{"progress": 0.1}]}'), ("none", "[]"), ("bare", '[{"progress": 0.1}]')], "name string, value string")
    assert {tuple(r) for r in trace_files.refused_exchange(texts).collect()} == {("other", "format"), ("new", "version"), ("none", "no_samples")}
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "ref string, target string")
    places = spark.createDataFrame([("a", "x", "t"), ("b", "x", "t"), ("c", "y", "t")], "name string, car_id string, track_id string")
    assert {r.target for r in trace_files.refused_pairs(pairs, places).collect()} == {"c", "d"}


def test_predict_and_evaluate(spark):
    data = spark.createDataFrame([(float(x), 2.0 * x + 1, x % 3) for x in range(12)], f"{learn.FEATURE} double, {learn.TARGET} double, seed int")
    model = learn.fit_line(data.where("seed != 2"))
    made = learn.predict(model, data.where("seed = 2"))
    assert all(r.prediction == pytest.approx(r[learn.TARGET]) for r in made.collect())
    assert learn.evaluate(data, made.select(learn.FEATURE, "prediction"), spark.createDataFrame([(2,)], "seed int")).first().mae == pytest.approx(0)
    assert learn.residuals(made).agg(F.max(F.abs("residual"))).first()[0] == pytest.approx(0)
    with pytest.raises(ValueError, match="lacks columns"):
        learn.predict(model, data.drop(learn.FEATURE))
    with pytest.raises(Exception, match="lacks one of"):
        learn.predict(model, data.withColumn(learn.FEATURE, F.lit(None).cast("double"))).collect()


def test_live_delta_equals_interpolation(spark):
    rng = random.Random(2)
    points = sorted({round(rng.random(), 2) for _ in range(40)})
    ref = spark.createDataFrame([("c", "t", p, 50 * p * p) for p in points] + [("c", "one", 0.5, 1.0)], "car_id string, track_id string, progress double, elapsed_seconds double")
    asked = [("c", "t", p / 200, 1.0) for p in range(201)] + [("c", "t", p, 1.0) for p in points] + [("c", "one", 0.5, 1.0), ("d", "t", 0.5, 1.0)]
    got = traces.live_delta(spark.createDataFrame(asked, "car_id string, track_id string, progress double, elapsed_seconds double"), ref).collect()
    assert len(got) == len(asked)
    for r in got:
        if (r.car_id, r.track_id) == ("c", "t"):
            inside = points[0] <= r.progress <= points[-1]
            assert (r.unavailable_reason is None) == inside and (not inside or r.delta_seconds == pytest.approx(1 - np.interp(r.progress, points, [50 * p * p for p in points])))
        else:
            assert r.unavailable_reason == ("too_few_samples" if r.car_id == "c" else "incompatible")


def test_lap_traces_equal_a_loop(spark):
    """Random walks of samples against a loop that keeps the last accepted one."""
    rng, rows, want = random.Random(6), [], []
    for source in range(4):
        arrival = 0
        for lap in range(4):
            kept, p, e = [], 0.0, 0.0
            for _ in range(30):
                p, e = max(0.0, min(1.0, p + rng.choice((-0.02, 0.0, 0.04, 0.08)))), max(0.0, e + rng.choice((-1, 0, 1, 2)))
                rows.append((source, arrival, lap, p, e))
                arrival += 1
                if kept and (e < kept[-1][1] or p < kept[-1][0]):
                    continue
                if kept and p == kept[-1][0]:
                    kept[-1] = (p, e)
                else:
                    kept.append((p, e))
            if lap < 3 and len(kept) >= 3 and kept[0][0] <= 0.05 and kept[-1][0] >= 0.9:
                want += [(source, lap + 1, i, *s) for i, s in enumerate(kept)]
    df = spark.createDataFrame(rows, "source_id int, arrival int, completed_laps int, progress double, elapsed_seconds double").withColumns({"session_number": F.lit(1), "last_time_ms": F.lit(90000)} | {c: F.lit(0.0) for c in ("speed_kmh", "throttle", "brake", "steering_angle_deg")})
    got = events.lap_traces(df.repartition(3)).select("source_id", "lap_number", "sample_index", "progress", "elapsed_seconds").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_upsert_table_skips_and_replaces(spark, tmp_path):
    t = trace(spark, BRAKING, (*P, "brake")).withColumn("lap_time_ms", F.lit(90000))
    trace_files.write_traces(t, str(tmp_path / "t"))
    trace_files.write_traces(t.withColumn("speed_kmh", F.lit(1.0)).limit(5), str(tmp_path / "t"))
    trace_files.write_traces(t.withColumn("lap_number", F.lit(2)), str(tmp_path / "t"))
    got = trace_files.read_traces(spark, str(tmp_path / "t"))
    assert {(r.lap_number, r["count"]) for r in got.groupBy("lap_number").count().collect()} == {(1, 5), (2, 13)}
    assert trace_files.mixed_laps(got).count() == 0


def test_sweep_and_regression(spark):
    sweep = spark.createDataFrame([("a", 23.0, 23.2, 24.7, 3.4), ("a", 24.5, 24.7, 24.7, 3.0), ("a", 26.0, 26.2, 24.7, 3.5)], "sweep_id string, parameter_value double, front_pressure_psi double, rear_pressure_psi double, front_slip_angle_deg double")
    assert setups.sweep_eda(sweep).first().minimum_slip_value == 24.5
    corr = {r.metric: r.correlation for r in setups.sweep_correlations(sweep).collect()}
    assert corr["front_pressure_psi"] > 0.99 and corr["rear_pressure_psi"] is None
    rows = [(s, 23 + 0.5 * k, 2.7 + 0.08 * abs(23 + 0.5 * k - 24.5) + 1e-5 * s) for s in range(10, 60, 10) for k in range(7)]
    data = spark.createDataFrame([(s, abs(v - 24.5), y) for s, v, y in rows], f"seed int, {learn.FEATURE} double, {learn.TARGET} double")
    split = learn.group_split(data)
    line = learn.simple_regression(split.where("not is_test"))
    assert line.first().coefficient == pytest.approx(0.08, abs=1e-3)
    scored = split.where("is_test").crossJoin(line).withColumn("prediction", F.col("coefficient") * F.col(learn.FEATURE) + F.col("intercept"))
    assert learn.metrics(scored).first().r2 > 0.95
    assert split.groupBy("seed").agg(F.countDistinct("is_test").alias("n")).where("n > 1").count() == 0


def test_lap_time_text(spark):
    df = spark.createDataFrame([(104500, -500), (None, None), (59999, 1250)], "a int, b int").select(scalars.lap_time_text(F.col("a")), scalars.signed_delta_text(F.col("b")))
    assert [tuple(r) for r in df.collect()] == [("1:44.500", "-0.500 s"), ("--:--.---", None), ("0:59.999", "+1.250 s")]


def test_scratch_tables_go(spark):
    import glob

    from paddock.functions.storage import scratch, shared_folder, stored

    found = lambda: glob.glob(f"{shared_folder(spark).removeprefix('file:')}/gone-*")
    with scratch(spark):
        assert stored(spark.range(3), "gone").count() == 3 and len(found()) == 1
        kept = stored(spark.range(4), "kept", keep=True)
    assert not found() and kept.count() == 4


def test_parabola_and_split(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 5, 200)
    y = 2 - 0.5 * x + 0.25 * x * x + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(int(i % 20), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "seed long, x double, y double")
    got = learn.fit_parabola(df, "x", "y").first()
    assert np.allclose([got.c2, got.c1, got.c0], np.polyfit(x, y, 2))
    assert learn.fit_parabola(df.where("seed < 0"), "x", "y").first().c0 is None and learn.fit_parabola(df.withColumn("x", F.lit(1.0)), "x", "y").first().c1 is None
    split = learn.group_split(df).groupBy("seed").agg(F.countDistinct("is_test").alias("n"), F.max("is_test").alias("t")).collect()
    assert sum(r.t for r in split) == 4 and all(r.n == 1 for r in split)
    found = {r.model: r.rmse for r in learn.compare_curves(learn.group_split(df), "x", "y").collect()}
    assert found["polynomial_2"] < 0.2 < found["linear"]


def test_decode_tells_all_faults(spark):
    value = b'{"schema_version":99,"source":"","session_type":"race","setup_id":null,"frame":{"session_id":"s"}}'
    df = spark.createDataFrame([(b"k", value, "t", 0, 0), (b"s", None, "t", 0, 1)], "key binary, value binary, topic string, partition int, offset long")
    got = kafka.decode(df).orderBy("kafka_offset").collect()
    assert got[0].decode_faults == ["unsupported_schema", "invalid_metadata"] and got[0].decode_error == "unsupported_schema" and got[0].schema_version == 1
    assert got[1].decode_error == "invalid_json" and got[1].source_file == "kafka://t/0/1"


def test_bronze_folders_do_not_grow_with_sessions(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "concat('s', id % 200) AS session_id", "id AS sample_index", "timestamp_seconds(id) AS timestamp", "date'2024-01-01' AS date", "concat('car', id % 2) AS car_id", "concat('track', id % 2) AS track_id"
    )
    path = str(tmp_path / "bronze")
    frames.write_table(rows, path)
    assert len(list((tmp_path / "bronze").glob("date=*/car_id=*/track_id=*"))) == 2 and len(list((tmp_path / "bronze").rglob("*.parquet"))) < 20
    frames.write_table(frames.new_sessions(rows, spark.read.parquet(path)), path)
    assert spark.read.parquet(path).count() == 400
    assert frames.new_sessions(rows.withColumn("session_id", F.lit("s201")), spark.read.parquet(path)).count() == 400


def test_silver_is_computed_once_for_both_tables(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = spark.createDataFrame([(f"s{i % 5}", i) for i in range(100)], "session_id string, sample_index long")
    valid, bad = (rows.where(c).mapInPandas(counted, rows.schema) for c in ("sample_index % 10 > 0", "sample_index % 10 = 0"))
    path = str(tmp_path / "silver")
    frames.write_silver(spark, valid, bad, path)
    assert seen.value == 100
    assert [versions.read(spark, path, t).count() for t in ("valid", "quarantine")] == [90, 10]


def test_quick_fingerprint(spark):
    base = [("a", 1, None, 2.0), ("a", None, 1, 3.0), ("b", 5, 6, None)]
    of = lambda rows: {r.k: r.fingerprint for r in parity.quick_fingerprint(spark.createDataFrame(rows, "k string, x int, y int, z double"), ("k",)).collect()}
    first = of(base)
    assert of(base[::-1]) == first
    swapped = of([("a", None, 1, 2.0), *base[1:]])  # the null in another column
    assert swapped["a"] != first["a"] and swapped["b"] == first["b"]
    assert of([*base, base[2]])["b"] != first["b"] and of([*base[:2], ("b", 5, 6, 0.0)])["b"] != first["b"]


def test_training_rows_are_dealt_evenly(spark):
    rows = spark.range(1000).selectExpr("id", "0 AS seed").repartition(4, "seed")  # all in one task
    sizes = learn.evenly(rows, 100).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 200


def test_records_keep_columns_without_a_join(spark):
    from paddock.plans import storage_queries

    plan = storage_queries.broker_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
