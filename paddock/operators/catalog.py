"""Catalog tables: keyed upsert, missing dimension rows, loads, lists and stored analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paddock.functions import versions

KEYS = {
    "cars": ("car_key",), "tracks": ("track_key",), "setups": ("setup_key",), "sessions": ("id",), "laps": ("session_id", "lap_number"), "sectors": ("session_id", "lap_number", "sector_number"),
    "lap_traces": ("session_id", "lap_number"), "experiments": ("id",), "ml_runs": ("id",), "gold_session_metrics": ("session_id",),
}


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], newest: Sequence[Column] = ()) -> DataFrame:
    """Both tables with one row for each key: of ``new`` before ``existing``, then the first by ``newest``.

    ``newest`` should order rows totally, so that the choice doesn't depend on their place.
    """
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new"), *newest))
    return both.withColumn("__n", n).where("__n = 1").drop("__n", "__new")


def missing_dimension(facts: DataFrame, fact_key: str, dimension: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Stub rows, named after their key, for keys of ``facts`` that ``dimension`` lacks."""
    return facts.select(F.col(fact_key).alias(key)).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti").withColumn(name, F.col(key).cast("string"))


def session_stubs(events: DataFrame, sessions: DataFrame, occurred: str = "occurred_at") -> DataFrame:
    """For events of unknown sessions, a session with what its first event tells."""
    first = F.min(F.struct(occurred, "car_id", "track_id"))
    stubs = events.groupBy("session_id").agg(first.alias("e")).select(F.col("session_id").alias("id"), F.col("e.car_id").alias("car_key"), F.col("e.track_id").alias("track_key"), F.col(f"e.{occurred}").alias("started_at"))
    return stubs.join(sessions.select("id"), "id", "left_anti")


def load_counts(kinds: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each kind a load brings."""
    parts = [df.select(F.lit(kind).alias("kind")) for kind, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


def load(kinds: dict[str, DataFrame], folder: str, newest: Sequence[Column] = (), batch: tuple[str, int] | None = None) -> DataFrame | None:
    """Rows of each kind into its catalog table under ``folder``, by the kind's key, all in one commit; returns how many rows of each kind came.

    With ``batch``, its source and number, a load is done once: None, and nothing changes, if that or a later batch of the source was loaded before. Of a load's rows
    with one key the first by ``newest`` counts. Only the parts of a table that hold a key of the load are rewritten.
    """
    spark = next(iter(kinds.values())).sparkSession
    changes = [versions.Change(kind, upsert(rows.limit(0), rows, KEYS[kind], newest), KEYS[kind]) for kind, rows in kinds.items()]
    return None if versions.put(spark, folder, changes, batch) is None else load_counts(kinds)


def loaded(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """A catalog table as of the newest load."""
    return versions.read(spark, folder, kind)


def load_stream(stream: DataFrame, kind: str, folder: str, checkpoint: str, newest: Sequence[Column] = ()) -> StreamingQuery:
    """Each micro-batch of a stream loaded once, also if it is delivered again after a failure or under a new checkpoint that counts its batches alike."""

    def each(batch: DataFrame, number: int) -> None:
        load({kind: batch}, folder, newest, (kind, number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_sessions(sessions: DataFrame, laps: DataFrame, traces: DataFrame, limit: int = 20) -> DataFrame:
    """The newest sessions with their numbers of laps and traces."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    count = lambda df, name: df.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    newest = sessions.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    return newest.join(count(laps, "lap_count"), "id", "left").join(count(traces, "trace_count"), "id", "left").fillna(0, ["lap_count", "trace_count"])


def latest(sessions: DataFrame, source: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest session, of one source or of each value of ``by``."""
    rows = sessions if source is None else sessions.where(F.col("source") == source)
    if not by:
        return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(1)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("started_at"), F.desc("id")))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def listed(rows: DataFrame, order: Sequence[str], **equal) -> DataFrame:
    """Rows with the given values, in order: sessions of a car, laps of a session, sectors of a lap."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows.orderBy(*order)


def store_analyses(reports: DataFrame, analysis_id: Column, created_at: Column, key: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Reports as JSON documents with id, time and key; stored analyses are only added."""
    return reports.select(analysis_id.alias("analysis_id"), *key, created_at.alias("created_at"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def recent_analyses(analyses: DataFrame, limit: int = 20, session_id: str | None = None) -> DataFrame:
    rows = analyses if session_id is None else analyses.where(F.col("session_id") == session_id)
    return rows.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(limit)


def metrics_store(gold: DataFrame, version: int = 1) -> DataFrame:
    """Gold rows as a JSON map of metrics with row count and duration."""
    metrics = [c for c, t in gold.dtypes if t in ("double", "bigint", "int")]
    return gold.select("session_id", F.col("sample_count").alias("row_count"), "duration_seconds", F.to_json(F.struct(*metrics), {"ignoreNullFields": "false"}).alias("metrics"), F.lit(version).alias("schema_version"))
