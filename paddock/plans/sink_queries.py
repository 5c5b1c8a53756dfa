"""Queries that write tables and streams and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import versions
from paddock.functions.storage import folder, stored
from paddock.operators import catalog, parity, quality, sessions, traces
from paddock.plans import storage_queries
from paddock.plans.session_queries import AUDIT_SQL, ONCE_SQL, _once, query
from paddock.plans.views import LAPS_SQL, TRACE_SQL, laps, trace
from paddock.schemas import BROKER_RECORD, require_columns
from paddock.sources import frames, tables
from paddock.sources import traces as trace_files
from paddock.streaming import stages


_EVEN = "CAST(substr(session_id, 2) AS BIGINT) % 2 = 0"


@query(
    f"SELECT session_id, CASE WHEN is_valid OR {_EVEN} THEN 'valid' ELSE 'quarantine' END AS tree, count(*) AS rows, sum(sample_index) AS indexes FROM ({AUDIT_SQL}) GROUP BY ALL"
)
def a9_silver_sink(spark, sf_dir):
    """Silver written twice: in the second run the sessions with even numbers come corrected, and none of their rows may stay in quarantine."""
    path = folder(spark, "silver")
    first = stored(_once(spark, sf_dir), "frames")
    judged = lambda rows: quality.split(stored(quality.silver_rows(rows), "silver"))
    frames.write_silver(spark, *judged(first), path, at_rest=True)
    mended = first.where("substring(session_id, 2) % 2 = 0").withColumns(
        {"vehicle_throttle": F.least("vehicle_throttle", F.lit(1.0)), "vehicle_speed_kmh": F.coalesce("vehicle_speed_kmh", F.lit(0.0)), "fl_load_n": F.greatest("fl_load_n", F.lit(0.0))}
    )
    frames.write_silver(spark, *judged(mended), path, at_rest=True)
    both = [versions.read(spark, path, t).select("session_id", F.lit(t).alias("tree"), "sample_index") for t in ("valid", "quarantine")]
    return both[0].unionByName(both[1]).groupBy("session_id", "tree").agg(F.count(F.lit(1)).alias("rows"), F.sum("sample_index").alias("indexes"))


def _records_chain(spark: SparkSession, sf_dir: str, run: str, **settings) -> stages.Chain:
    """The chain over broker records in files: one micro-batch a stage."""
    storage_queries.broker_records(spark, sf_dir).write.option("compression", "zstd").parquet(f"{run}/in")
    feed = stages.files(spark, f"{run}/in", BROKER_RECORD, 1000)
    return stages.records_chain(spark, feed, f"{run}/out", stages.Settings(BROKER_RECORD.simpleString(), files_per_trigger=1000, **settings))


@query(storage_queries.DECODED_SQL)
def h9_kafka_bronze(spark, sf_dir):
    """The stream from broker records to audited rows."""
    run = folder(spark, "kafka")
    _records_chain(spark, sf_dir, run).run()
    return storage_queries.decoded(spark.read.parquet(f"{run}/out/audit"))


_KAFKA_VALID = f"SELECT * FROM ({AUDIT_SQL}) WHERE is_valid AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0"


@query(
    f"WITH good AS ({_KAFKA_VALID}), daily AS (SELECT session_id, date_trunc('day', timestamp) AS day, count(*) AS n FROM good GROUP BY ALL) "
    "SELECT 'silver' AS stage, session_id, count(*) AS rows, count(*) AS samples FROM good GROUP BY session_id UNION ALL "
    "SELECT 'analytics', session_id, count(*), CAST(sum(n) AS BIGINT) FROM daily WHERE day + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM good) - INTERVAL 10 SECOND GROUP BY session_id"
)
def h9_kafka_chain(spark, sf_dir):
    """Broker records through Bronze, audit, Silver and daily windows; a second run finds nothing new."""
    run = folder(spark, "chain")
    chain = _records_chain(spark, sf_dir, run, window="1 day")
    chain.run()
    chain.run()
    silver, windows = (spark.read.parquet(f"{run}/out/{s}") for s in ("silver", "analytics"))
    one = F.lit(1).alias("n")
    rows = silver.select(F.lit("silver").alias("stage"), "session_id", one).unionByName(windows.select(F.lit("analytics").alias("stage"), "session_id", F.col("sample_count").alias("n")))
    return rows.groupBy("stage", "session_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("samples"))


_LATE = f"SELECT *, event_id % 3 = 0 AS second, max(CASE WHEN event_id % 3 <> 0 THEN timestamp END) OVER () - INTERVAL 1 DAY AS mark FROM ({AUDIT_SQL}) WHERE is_valid"


@query(
    "SELECT 'audit' AS stage, CAST(0 AS BIGINT) AS late_rows, count(*) AS input_rows FROM events UNION ALL "
    f"SELECT 'silver', CAST(sum(CASE WHEN second AND timestamp <= mark THEN 1 ELSE 0 END) AS BIGINT), (SELECT count(*) FROM events) FROM ({_LATE}) UNION ALL "
    f"SELECT 'kept', CAST(0 AS BIGINT), CAST(sum(CASE WHEN second AND timestamp <= mark THEN 0 ELSE 1 END) AS BIGINT) FROM ({_LATE})"
)
def h4_late_rows(spark, sf_dir):
    """Frames in two runs: what each stage's batches took in, and how many rows of the second run came later than the watermark that the first one left."""
    run = folder(spark, "late")
    source = _once(spark, sf_dir)
    chain = None
    for part in (False, True):
        source.where((F.col("event_id") % 3 == 0) == part).write.mode("append").parquet(f"{run}/in")
        chain = chain or stages.frames_chain(spark, f"{run}/in", source.schema, f"{run}/out", stages.Settings(source.schema.simpleString(), watermark="1 day", files_per_trigger=1000))
        chain.run()
    done = spark.read.parquet(f"{run}/out/progress").where("stage <> 'analytics'").groupBy("stage").agg(F.sum("late_rows").alias("late_rows"), F.sum("input_rows").alias("input_rows"))
    kept = spark.read.parquet(f"{run}/out/silver").agg(F.lit("kept").alias("stage"), F.lit(0).cast("long").alias("late_rows"), F.count(F.lit(1)).alias("input_rows"))
    return done.unionByName(kept)


@query(
    "SELECT session_id, lap_number, count(*) AS samples, CAST(sum(sample_index) AS BIGINT) AS indexes, sum(speed_kmh) AS speed_sum, count(clutch) "
    f"AS clutches FROM ({TRACE_SQL}) GROUP BY 1, 2",
    "speed_sum",
)
def a11_trace_table(spark, sf_dir):
    """The trace table written and read, with the laps of even sessions written a second time."""
    path = folder(spark, "traces")
    rows = trace(spark, sf_dir).withColumn("lap_time_ms", F.lit(90000))
    trace_files.write_traces(rows, path)
    trace_files.write_traces(rows.where("substring(session_id, 2) % 2 = 0"), path)
    read = trace_files.read_traces(spark, path)
    return read.groupBy(*traces.LAP).agg(F.count(F.lit(1)).alias("samples"), F.sum("sample_index").alias("indexes"), F.sum("speed_kmh").alias("speed_sum"), F.count("clutch").alias("clutches"))


@query(f"SELECT session_id, lap_number, lap_time_ms, lap_key FROM ({LAPS_SQL}) WHERE lap_time_ms IS NOT NULL AND lap_number % 5 <> 0")
def a7_dataset_round_trip(spark, sf_dir):
    """Laps as CSV, some without a time, read by their columns: rows that lack one are left out."""
    path = folder(spark, "laps") + "/laps.csv"
    rows = laps(spark, sf_dir).withColumn("lap_time_ms", F.when(F.col("lap_number") % 5 != 0, F.col("lap_time_ms")))
    tables.write_csv(rows, path)
    return tables.read_dataset(spark, path, ("session_id", "lap_number", "lap_time_ms", "lap_key"), rows.schema)


@query("SELECT s_suppkey AS id, s_nationkey AS dataset FROM supplier WHERE s_nationkey % 3 = 1")
def a15_json_catalog(spark, sf_dir):
    """A log of runs as JSON lines, read with its schema and looked up by a column."""
    path = folder(spark, "runs")
    runs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("dataset"), (F.col("s_nationkey") % 3).alias("model"))
    tables.append_run(runs.where("id % 2 = 0"), path)
    tables.append_run(runs.where("id % 2 = 1"), path)
    return tables.get(tables.read_catalog(spark, path, runs.schema, multi_line=False), "model", 1).select("id", "dataset")


@query(f"SELECT session_id, count(*) AS rows FROM ({ONCE_SQL}) GROUP BY session_id")
def a5_bronze_ingest(spark, sf_dir):
    """Accepted frames of two runs over the same sessions: the second finds them stored and writes none."""
    path = folder(spark, "bronze")
    nested = stored(frames.unflatten(_once(spark, sf_dir)), "frames")
    seen = nested.groupBy("session_id").agg(
        F.first("car_id").alias("car_id"), F.first("track_id").alias("track_id"), F.first("setup_id").alias("setup_id"), F.first("session_type").alias("session_type"),
        F.lit("events").alias("source"), F.min("timestamp").alias("started_at"), F.count(F.lit(1)).alias("sample_count"),
    )
    metadata = stored(seen, "metadata")
    rows, _ = frames.bronze(nested.drop("setup_id", "session_type", "telemetry_source"), metadata)
    frames.write_table(rows, path)
    frames.write_table(frames.new_sessions(rows, spark.read.parquet(path)), path)
    return require_columns(spark.read.parquet(path), (*frames.PARTITIONS, "session_id")).groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))


_STUBS = f"SELECT session_id AS id, car_id AS car_key, track_id AS track_key, CAST(min(timestamp) AS TIMESTAMP) AS started_at FROM ({ONCE_SQL}) WHERE NOT ({_EVEN}) GROUP BY ALL"


@query(_STUBS)
def a13_session_stubs(spark, sf_dir):
    """Sessions that no catalog knows, from their first event."""
    events = _once(spark, sf_dir).select("session_id", "car_id", "track_id", F.col("timestamp").alias("occurred_at"))
    known = events.where("substring(session_id, 2) % 2 = 0").select(F.col("session_id").alias("id")).distinct()
    return catalog.session_stubs(events, known).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


_LOADED = f"SELECT session_id, lap_number, CASE WHEN lap_number % 2 = 0 THEN lap_time_ms + 1 ELSE lap_time_ms END AS lap_time_ms, occurred_at FROM ({LAPS_SQL})"


@query(f"SELECT session_id, count(*) AS laps, CAST(sum(lap_time_ms) AS BIGINT) AS total_ms FROM ({_LOADED}) GROUP BY session_id")
def a14_event_load(spark, sf_dir):
    """Completed laps loaded in two drains; the second brings later laps and corrects the even ones."""
    path = folder(spark, "catalog")
    rows = laps(spark, sf_dir).select("session_id", "lap_number", "lap_time_ms", "occurred_at")
    catalog.load({"laps": rows.where("lap_number <= 3 or lap_number % 2 = 0")}, path)
    later = rows.where("lap_number > 3 or lap_number % 2 = 0").withColumn("lap_time_ms", F.when(F.col("lap_number") % 2 == 0, F.col("lap_time_ms") + 1).otherwise(F.col("lap_time_ms")))
    catalog.load({"laps": later}, path)
    return catalog.loaded(spark, path, "laps").groupBy("session_id").agg(F.count(F.lit(1)).alias("laps"), F.sum("lap_time_ms").alias("total_ms"))


_TWICE = "CASE WHEN lap_number % 2 = 0 THEN lap_time_ms + 1 ELSE lap_time_ms END"


@query(f"SELECT session_id, count(*) AS laps, CAST(sum({_TWICE}) AS BIGINT) AS total_ms, 2 AS commits FROM ({LAPS_SQL}) GROUP BY session_id")
def a14_replayed_load(spark, sf_dir):
    """Laps loaded by a stream of two micro-batches; both are delivered again under a new checkpoint, with other times, and change nothing."""
    path = folder(spark, "catalog")
    rows = laps(spark, sf_dir).select("session_id", "lap_number", "lap_time_ms", "occurred_at")
    rows.write.parquet(f"{path}/in-1")
    rows.where("lap_number % 2 = 0").withColumn("lap_time_ms", F.col("lap_time_ms") + 1).write.parquet(f"{path}/in-2")
    schema = spark.read.parquet(f"{path}/in-1").schema
    for checkpoint, add in (("first", 0), ("again", 1000)):
        for part in (1, 2):
            delivered = stages.read_stream(spark, f"{path}/in-{{{','.join(map(str, range(1, part + 1)))}}}", schema, 1000).withColumn("lap_time_ms", F.col("lap_time_ms") + add)
            catalog.load_stream(delivered, "laps", path, f"{path}/{checkpoint}").awaitTermination()
    commits = versions.snapshot(spark, path)["number"]
    return catalog.loaded(spark, path, "laps").groupBy("session_id").agg(F.count(F.lit(1)).alias("laps"), F.sum("lap_time_ms").alias("total_ms")).withColumn("commits", F.lit(commits))


_SEVENTH = "CAST(substr(session_id, 2) AS BIGINT) % 7 = 0"


@query(
    f"SELECT session_id, CASE WHEN {_SEVENTH} THEN 2 ELSE 1 END AS made_in, CASE WHEN {_SEVENTH} THEN 'computed' ELSE 'skipped' END AS status, count(*) AS sample_count, "
    f"max(vehicle_speed_kmh) + CASE WHEN {_SEVENTH} THEN 1 ELSE 0 END AS maximum_speed_kmh FROM ({AUDIT_SQL}) WHERE is_valid GROUP BY session_id",
    "maximum_speed_kmh",
)
def a17_incremental_gold(spark, sf_dir):
    """Gold summaries kept twice, the second time with every seventh session changed: only those are computed again, as the manifest tells."""
    path = folder(spark, "gold")
    valid = stored(quality.silver(_once(spark, sf_dir))[0], "silver")
    parity.refresh(valid, path, "gold", sessions.gold_summary)
    changed = valid.withColumn("vehicle_speed_kmh", F.when(F.substring("session_id", 2, 20).cast("long") % 7 == 0, F.col("vehicle_speed_kmh") + 1).otherwise(F.col("vehicle_speed_kmh")))
    status = parity.refresh(changed, path, "gold", sessions.gold_summary)
    gold = versions.read(spark, path, "gold").select("session_id", "sample_count", "maximum_speed_kmh")
    return gold.join(versions.read(spark, path, "gold_manifest").select("session_id", "made_in"), "session_id").join(status, "session_id")


@query(
    f"SELECT session_id, count(*) AS frames, sum(sample_index) AS indexes FROM ({ONCE_SQL}) WHERE event_id % 101 <> 0 GROUP BY session_id "
    f"UNION ALL SELECT 'corrupt', count(*), NULL FROM ({ONCE_SQL}) WHERE event_id % 101 = 0"
)
def a1_raw_files(spark, sf_dir):
    """Frames as JSON lines in files, some cut short and some blank, read with the broken lines apart."""
    path = folder(spark, "raw")
    nested = frames.unflatten(_once(spark, sf_dir))
    line = F.to_json(F.struct("timestamp", "session_id", "sample_index", "elapsed_seconds", "car_id", "track_id", "vehicle", "environment", "wheels"))
    cut = nested.select(F.when(F.col("event_id") % 101 == 0, F.substring(line, 1, 60)).otherwise(line).alias("value"))
    cut.unionByName(cut.select(F.lit("  ").alias("value")).limit(5)).write.text(path)
    good, corrupt = frames.read_frames(spark, path)
    counted = good.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("sample_index").alias("indexes"))
    return counted.unionByName(corrupt.agg(F.lit("corrupt").alias("session_id"), F.count(F.lit(1)).alias("frames"), F.lit(None).cast("long").alias("indexes")))
