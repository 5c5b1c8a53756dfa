"""Streaming stages over files: audit, de-duplication, closed windows, late rows and frozen settings."""

import pytest
from pyspark.sql import functions as F

from paddock.operators import quality
from paddock.streaming import stages



def rows(spark, items):
    """(index, second or None, speed, throttle) as frames of one session."""
    df = spark.createDataFrame(items, "sample_index long, second int, vehicle_speed_kmh double, vehicle_throttle double")
    fixed = {c: F.lit(1.0) for c in quality.REQUIRED if c not in ("timestamp", "session_id", "car_id", "track_id", "sample_index", "vehicle_speed_kmh", "vehicle_throttle")}
    return df.withColumns(fixed | {"timestamp": F.timestamp_seconds("second"), "session_id": F.lit("s"), "car_id": F.lit("c"), "track_id": F.lit("t")}).drop("second").coalesce(1)


def test_stages(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = rows(spark, [(0, 1, 80.0, 0.5), (0, 1, 80.0, 0.5), (1, 3, 120.0, 0.5), (2, 3, 100.0, 1.5), (3, None, 100.0, 0.5)])
    first.write.mode("append").parquet(source)
    stages.frames_chain(spark, source, first.schema, out).run()
    assert spark.read.parquet(f"{out}/audit").count() == 5
    assert spark.read.parquet(f"{out}/silver").count() == 2
    assert stages.quarantine(spark, out).count() == 2
    rows(spark, [(4, 2, 100.0, 0.5), (5, 40, 90.0, 0.5)]).write.mode("append").parquet(source)
    stages.frames_chain(spark, source, first.schema, out).run()
    rows(spark, [(6, 1, 60.0, 0.5), (7, 80, 90.0, 0.5)]).write.mode("append").parquet(source)
    late = stages.frames_chain(spark, source, first.schema, out).run()
    assert {r.stage: r.n for r in late.groupBy("stage").agg(F.sum("late_rows").alias("n")).collect()} == {"audit": 0, "silver": 1, "analytics": 0}
    assert sorted(r.sample_index for r in spark.read.parquet(f"{out}/silver").collect()) == [0, 1, 4, 5, 7]  # the late row 6 is only in the audit
    assert spark.read.parquet(f"{out}/audit").count() == 9
    closed = spark.read.parquet(f"{out}/analytics").orderBy("window_start").collect()
    assert (closed[0].sample_count, closed[0].average_speed_kmh, closed[0].maximum_speed_kmh) == (3, 100, 120)
    with pytest.raises(ValueError, match="other settings"):
        stages.frames_chain(spark, source, first.schema, out, stages.Settings(first.schema.simpleString(), window="5 seconds"))
    with pytest.raises(ValueError, match="nested"):
        stages.freeze(spark, stages.Settings("x"), f"{source}/out", source)


def test_continuous_group(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = rows(spark, [(0, 1, 80.0, 0.5), (1, 30, 120.0, 1.5), (2, 60, 100.0, 0.5)])
    first.write.mode("append").parquet(source)
    chain = stages.frames_chain(spark, source, first.schema, out)
    with chain.running(every="100 milliseconds") as live:
        for _ in range(3):
            live.caught_up()
        assert spark.read.parquet(f"{out}/audit").count() == 3 and spark.read.parquet(f"{out}/silver").count() == 2
        assert sum(r[2] for r in live.progress() if r[0] == "audit") == 3
    assert not any(q.isActive for q in live.queries.values())
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        with pytest.raises(ValueError, match="other settings"):
            stages.frames_chain(spark, source, first.schema, out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_live_events_over_batches(spark, tmp_path):
    from paddock.operators import events
    from paddock.streaming import live

    columns = "source_id long, arrival long, packet_id long, status string, car_model string, track string, session_type string, completed_laps long, current_sector_index long, last_time_ms long, best_time_ms long, last_sector_time_ms long, position long"
    made = [(s, n, n, "LIVE", "c" if n < 25 else "d", "t", "race", n // 6 % 4, n // 2 % 3, 60000 + n, 60010, 20000 + n, 1) for s in (1, 2) for n in range(40)]
    whole = spark.createDataFrame(made, columns)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 7), (7, 20), (20, 40)):
        whole.where(f"arrival >= {low} and arrival < {high}").coalesce(1).write.mode("append").parquet(source)
        stages.start(live.live_events(stages.read_stream(spark, source, whole.schema)), out, "events").awaitTermination()
    got = {(r.source_id, r.session_number, r.arrival, r.kind, r.lap_number, r.sector_number, r.time_ms) for r in spark.read.parquet(f"{out}/events").collect()}
    flags = events.progress_flags(events.sessionize(whole))
    want = {(r.source_id, r.session_number, r.arrival, "lap", r.lap_number, None, r.lap_time_ms) for r in events.lap_events(flags).collect()}
    want |= {(r.source_id, r.session_number, r.arrival, "sector", r.lap_number, r.sector_number, r.sector_time_ms) for r in events.sector_events(flags).collect()}
    assert got == want
