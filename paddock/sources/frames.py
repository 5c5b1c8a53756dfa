"""Raw frames, session metadata, flat Bronze rows and their table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions import versions
from paddock.functions.storage import stored
from paddock.schemas import ENVIRONMENT_FIELDS, FRAME, SESSION_METADATA, VEHICLE_FIELDS, WHEEL_FIELDS, WHEELS, require_columns

CORRUPT = "_corrupt_record"
#: Folders of the Bronze table: as many as there are days, cars and tracks. A session is a column that files are sorted by, since a folder for each would make files grow with sessions
PARTITIONS = ("date", "car_id", "track_id")


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, corrupt lines) of JSON lines; blank lines are skipped. A frame keeps its file as ``source_file``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file")).where(F.trim("value") != "")
    return parse_frames(lines)


def parse_frames(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    schema = T.StructType([*FRAME.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("__f", F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"__f.{CORRUPT}").isNotNull() | F.col("__f").isNull() | F.col("__f.session_id").isNull()
    rest = [c for c in lines.columns if c != value]
    return parsed.where(~bad).select(*rest, *(f"__f.{c}" for c in FRAME.names)), parsed.where(bad).select(*rest, value)


def failed_sessions(corrupt: DataFrame) -> DataFrame:
    """Files with a line that isn't a frame: a bad line fails its whole session."""
    return corrupt.select("source_file").distinct()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files; rows with no samples or a negative duration are left out."""
    return spark.read.schema(SESSION_METADATA).option("multiLine", True).json(path).where("sample_count > 0 and duration_seconds >= 0")


def wheel_problems(frames: DataFrame) -> DataFrame:
    """(session_id, problem) of sessions whose frames don't all have the same wheels, or lack one of FL, FR, RL and RR."""
    wheels = F.array_sort(F.map_keys("wheels"))
    seen = frames.groupBy("session_id").agg(F.min(wheels).alias("a"), F.max(wheels).alias("b"), F.min(F.forall(F.array(*map(F.lit, WHEELS)), lambda w: F.array_contains(F.map_keys("wheels"), w))).alias("whole"), F.count_if(F.col("wheels").isNull()).alias("none"))
    problem = F.when((F.col("none") > 0) | ~F.coalesce("whole", F.lit(False)), "missing_wheel").when(F.col("a") != F.col("b"), "changing_wheels")
    return seen.select("session_id", problem.alias("problem")).where("problem is not null")


def _wheel(w: str) -> Column:
    return F.try_element_at("wheels", F.lit(w))


def flatten(frames: DataFrame) -> DataFrame:
    """Nested frames as flat rows: vehicle_, environment_ and a prefix for each wheel; other columns stay."""
    require_columns(frames, ("vehicle", "environment", "wheels"))
    plain = [c for c in frames.columns if c not in ("vehicle", "environment", "wheels")]
    return frames.select(
        *plain, *(F.col(f"vehicle.{f}").alias(f"vehicle_{f}") for f in VEHICLE_FIELDS), *(F.col(f"environment.{f}").alias(f"environment_{f}") for f in ENVIRONMENT_FIELDS),
        *(_wheel(w)[f].alias(f"{w.lower()}_{f}") for w in WHEELS for f in WHEEL_FIELDS),
    )


def unflatten(rows: DataFrame) -> DataFrame:
    """Flat rows as nested frames; columns that a row lacks are null. Replay order is (session_id, sample_index)."""
    have = set(rows.columns)
    value = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    plain = [c for c in rows.columns if not c.startswith(("vehicle_", "environment_", "fl_", "fr_", "rl_", "rr_"))]
    wheel = lambda w: F.struct(*(value(f"{w.lower()}_{f}").cast("double").alias(f) for f in WHEEL_FIELDS))
    longs = ("rpm", "gear")
    return rows.select(
        *plain, F.struct(*(value(f"vehicle_{f}").cast("long" if f in longs else "double").alias(f) for f in VEHICLE_FIELDS)).alias("vehicle"),
        F.struct(*(value(f"environment_{f}").cast("double").alias(f) for f in ENVIRONMENT_FIELDS)).alias("environment"), F.create_map(*(x for w in WHEELS for x in (F.lit(w), wheel(w)))).alias("wheels"),
    )


def bronze(frames: DataFrame, metadata: DataFrame, schema_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(Bronze rows, rejected sessions): a session's car, track and number of frames must be those of its metadata."""
    seen = frames.groupBy("session_id").agg(F.countDistinct("car_id", "track_id").alias("n"), F.first("car_id").alias("car"), F.first("track_id").alias("track"), F.count(F.lit(1)).alias("samples"))
    joined = seen.join(metadata, "session_id", "left")
    problem = (
        F.when(F.col("sample_count").isNull(), "no_metadata").when((F.col("n") != 1) | (F.col("car") != F.col("car_id")) | (F.col("track") != F.col("track_id")), "identity_mismatch")
        .when(F.col("samples") != F.col("sample_count"), "sample_count_mismatch")
    )
    judged = joined.withColumn("problem", problem)
    good = judged.where("problem is null").select("session_id", "setup_id", "session_type", F.col("source").alias("telemetry_source"), F.to_date("started_at").alias("date"))
    rows = flatten(frames.join(good, "session_id")).withColumns({"ingested_at": F.current_timestamp(), "schema_version": F.lit(schema_version)})
    return rows, judged.where("problem is not null").select("session_id", "problem", "samples", "sample_count")


def new_sessions(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of sessions that the table doesn't hold: Bronze is never written twice."""
    return rows.join(stored.select("session_id").distinct(), "session_id", "left_anti")


def write_table(rows: DataFrame, path: str, mode: str = "append", partitions: tuple[str, ...] = PARTITIONS) -> None:
    """Parquet by date, car and track; rows of a task are in order of session and time. ``overwrite`` replaces only the partitions it has rows for.

    Rows are first brought together by partition, so that each has few files; a large partition is split over tasks at run time. A session is
    found by the least and greatest session of files and row groups.
    """
    order = [*partitions, *(c for c in ("session_id", "timestamp", "sample_index") if c in rows.columns and c not in partitions)]
    rows.hint("rebalance", *partitions).sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_silver(spark: SparkSession, valid: DataFrame, quarantined: DataFrame, path: str, at_rest: bool = False) -> None:
    """Valid and quarantined rows as the tables ``valid`` and ``quarantine`` of a folder, in one commit. Both are computed once, or read again where they lie ``at_rest`` in a stored table.

    Every session of this run is replaced whole in both, so a row that was quarantined before and is valid now is in one table only, and a
    reader sees a session as it was before or as it is after.
    """
    session = ("session_id",)
    if not at_rest:
        valid, quarantined = stored(valid, "valid"), stored(quarantined, "quarantine")
    seen = stored(valid.select(*session).union(quarantined.select(*session)).distinct(), "sessions")
    versions.put(spark, path, [versions.Change("valid", valid, session, seen), versions.Change("quarantine", quarantined, session, seen)], at_rest=True)
