"""Live sources: every branch of what is shown, laps that close in a later micro-batch, timers of silent sources, and laps that reach the fold."""

import time

import pytest
import numpy as np
from pyspark.sql import functions as F

from paddock.operators import events, traces
from paddock.streaming import live, stages


def shown(steps, seconds=2.0, retry=0.0):
    monitor = events.Monitor(seconds, retry)
    return [monitor.step(clock, packet, status, bad) for clock, packet, status, bad in steps]


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([(0, 1, "LIVE", False), (2, 1, "LIVE", False), (2.1, 1, "LIVE", False)], ["live", "live", "disconnected"]),  # just 2 seconds are not too long
        ([(0, 1, "REPLAY", False), (3, 1, "REPLAY", False)], ["replay", "disconnected"]),  # a replay may stand still too
        ([(0, 1, "PAUSE", False), (50, 1, "PAUSE", False), (50.25, 1, "LIVE", False), (51, 2, "LIVE", False)], ["paused", "paused", "live", "live"]),
        ([(0, 1, "LIVE", True), (1, 2, "REPLAY", True), (2, 3, "PAUSE", True)], ["disconnected"] * 3),  # values that aren't numbers, whatever the status
        ([(0, 1, "LIVE", False), (1, 2, "BROKEN", False), (2, 3, None, False)], ["live", "disconnected", "disconnected"]),
        ([(0, 1, "OFF", True), (9, 1, "OFF", False)], ["waiting", "waiting"]),  # nothing is read of one that is off
        ([(0, 1, "LIVE", False), (3, 1, "LIVE", False), (4, 1, "LIVE", False), (7, 1, "LIVE", False)], ["live", "disconnected", "live", "disconnected"]),  # opened anew, it counts as changed
    ],
)
def test_branches_of_the_monitor(steps, want):
    assert shown(steps) == want


def test_given_up_sources_are_opened_anew_after_a_while():
    steps = [(0, 1, "OFF", False), (1, 1, "LIVE", False), (2, 2, "LIVE", False), (5, 2, "LIVE", False), (6, 3, "LIVE", False), (7, 3, "LIVE", False)]
    assert shown(steps, retry=2.0) == ["waiting", "waiting", "live", "disconnected", "disconnected", "live"]


SNAPSHOT = "source_id long, arrival long, packet_id long, status string, car_model string, track string, session_type string, completed_laps long, last_time_ms long, seen_at_seconds double, progress double, elapsed_seconds double, speed_kmh double, throttle double, brake double, steering_angle_deg double"


def snapshots(spark, laps=3, samples=40, source=1, first=0.0):
    """Laps of ``samples`` snapshots; some step back or stand still."""
    rows = []
    for n in range(laps * samples + 1):
        lap, k = divmod(n, samples)
        p = min(1.0, k / (samples - 1))
        p = p - 0.05 if k % 13 == 7 and lap != 1 else p
        rows.append((source, n, n, "LIVE", "c", "t", "race", lap, 90000 + lap, first + n * 0.5, p, k * 1.0, 100.0 + n, 0.5, 0.0, 1.0))
    return spark.createDataFrame(rows, SNAPSHOT)


def feed(spark, tmp_path, parts, make):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    with live.keyed_state(spark):
        for rows in parts:
            rows.coalesce(1).write.mode("append").parquet(source)
            stages.start(make(stages.read_stream(spark, source, parts[0].schema, 1000)), out, "x").awaitTermination()
    return spark.read.parquet(f"{out}/x")


def test_laps_close_in_later_batches(spark, tmp_path):
    whole = snapshots(spark).unionByName(snapshots(spark, source=2, laps=2))
    parts = [whole.where(f"arrival >= {a} and arrival < {b}") for a, b in ((0, 7), (7, 55), (55, 60), (60, 200))]
    parts.append(whole.where("arrival < 60"))  # delivered again, too late
    got = sorted(map(tuple, feed(spark, tmp_path, parts, live.live_traces).collect()))
    want = events.lap_traces(events.sessionize(whole)).collect()
    assert len({r[:3] for r in got}) == 5
    assert got == sorted(map(tuple, want))


def test_the_open_lap_of_a_silent_source_is_dropped(spark, tmp_path):
    timed = lambda df: df.withColumn("seen_at", F.timestamp_seconds("seen_at_seconds"))
    mine, other = timed(snapshots(spark, laps=1)), timed(snapshots(spark, source=2, first=500.0))
    make = lambda df: live.live_traces(df, seen_at="seen_at", watermark="1 second", silent_seconds=60)
    last = mine.where("arrival = 40").withColumn("seen_at", F.timestamp_seconds(F.lit(600.0)))
    parts = [mine.where("arrival < 40"), other.where("arrival < 100"), other.where("arrival >= 100"), last]
    got = feed(spark, tmp_path, parts, make)
    assert {(r.source_id, r.lap_number) for r in got.collect()} == {(2, 1), (2, 2), (2, 3)}


def test_a_silent_source_turns_disconnected_without_a_row(spark, tmp_path):
    """Timers by the cluster's clock need a stream that goes on: it is stopped here once the row is there."""
    whole = snapshots(spark, laps=1, samples=5)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    whole.coalesce(1).write.parquet(source)
    with live.keyed_state(spark):
        query = stages.start(live.live_states(stages.read_stream(spark, source, whole.schema), silent_ms=300), out, "x", every="200 milliseconds")
    try:
        for _ in range(80):
            time.sleep(0.5)
            states = [r.live_state for r in spark.read.schema(live.STATES).parquet(f"{out}/x").collect()] if query.lastProgress else []
            if "disconnected" in states:
                break
    finally:
        query.stop()
    assert sorted(states) == ["disconnected"] + ["live"] * 6


def test_null_statuses_and_sectors_on_the_stream(spark, tmp_path):
    rows = [(1, n, n, None if n == 1 else "LIVE", "c", "t", "race", n // 3, None if n == 2 else n % 3, 1, 1, 1, 1) for n in range(6)]
    df = spark.createDataFrame(rows, "source_id long, arrival long, packet_id long, status string, car_model string, track string, session_type string, completed_laps long, current_sector_index long, last_time_ms long, best_time_ms long, last_sector_time_ms long, position long")
    got = feed(spark, tmp_path, [df.where("arrival < 3"), df.where("arrival >= 3")], live.live_events)
    assert got.where("kind = 'lap'").count() == 1


def test_only_laps_that_step_back_reach_the_fold(spark):
    whole = events.sessionize(snapshots(spark, laps=6)).withColumn("lap", F.col("completed_laps"))
    marked = events.stepping_back(whole, ["source_id", "lap"], "arrival")
    assert sorted(r.lap for r in marked.where("__back").select("lap").distinct().collect()) == [0, 2, 3, 4, 5]  # lap 1 never does; the last has one sample
    plan = events.lap_traces(events.sessionize(snapshots(spark)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_alignment_of_a_session_of_thousands_of_laps(spark):
    laps = spark.range(5000).select((F.col("id") + 1).cast("int").alias("lap_number")).withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(4))))
    progress = F.col("sample_index") / 4
    trace = laps.select(F.lit("s").alias("session_id"), "lap_number", "sample_index", progress.alias("progress"), (progress * (80 + F.col("lap_number") % 7)).alias("elapsed_seconds"), *(F.lit(1.0).alias(c) for c in ("speed_kmh", "throttle", "brake", "steering_angle_deg")))
    pairs = trace.where("lap_number > 1").select("session_id", F.lit(1).alias("ref_lap"), F.col("lap_number").alias("target_lap")).distinct()
    aligned = traces.align(pairs, trace, points=11)
    assert aligned.count() == 4999 * 11
    bad = aligned.where(F.abs(F.col("time_delta_seconds") - F.col("progress") * (F.col("target_lap") % 7 - 1)) > 1e-9)
    assert bad.count() == 0


def test_time_deltas_are_those_of_the_whole_grid(spark):
    random = np.random.default_rng(3)
    rows = []
    for lap in range(1, 7):
        at = np.sort(np.round(random.uniform(0, 1, 60), 2))  # with equal progress
        rows += [("s", lap, i, float(p), float(60 * p + random.uniform()), 1.0, 1.0, 1.0, 1.0) for i, p in enumerate(at)]
    trace = spark.createDataFrame(rows, "session_id string, lap_number int, sample_index int, progress double, elapsed_seconds double, speed_kmh double, throttle double, brake double, steering_angle_deg double")
    pairs = spark.createDataFrame([("s", a, b) for a in (1, 2) for b in range(1, 7) if a != b], "session_id string, ref_lap int, target_lap int")
    aligned = traces.align(pairs, trace, 21)
    on_grid = aligned.select(*traces.PAIR, F.col("progress").alias("position"))
    places = pairs.crossJoin(spark.createDataFrame([(float(p),) for p in np.linspace(-0.1, 1.1, 61)], "position double")).unionByName(on_grid).distinct()
    want = {(r.ref_lap, r.target_lap, r.position): r.d for r in traces.time_delta_at(places, aligned, "position", "d").where("d is not null").collect()}
    made = traces.time_deltas(places, pairs, trace, 21)
    got = {(r.ref_lap, r.target_lap, r.position): r.time_delta_seconds for r in made.where("time_delta_seconds is not null").collect()}
    assert len(want) > 600 and got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_deltas_of_matched_parts_make_no_grid(spark, monkeypatch):
    from paddock.plans import trace_queries

    def refuse(*_, **__):
        raise AssertionError("the whole grid is made")

    monkeypatch.setattr(traces, "align", refuse)
    assert trace_queries.e25_advice(spark, "/root/testdata/sf0.001").count() > 0
