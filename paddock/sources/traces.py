"""Lap trace tables and lap exchange files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions import versions
from paddock.operators.traces import LAP
from paddock.schemas import TRACE, require_columns

REQUIRED = ("session_id", "lap_number", "car_id", "track_id", "lap_time_ms", "progress", "elapsed_seconds", "speed_kmh", "throttle", "brake", "steering_angle_deg")


def numbered(samples: DataFrame) -> DataFrame:
    """Samples of laps with a positive number and time, numbered in order of elapsed time and progress."""
    order = Window.partitionBy(*LAP).orderBy("elapsed_seconds", "progress")
    return samples.where("lap_number > 0 and lap_time_ms > 0").withColumn("sample_index", F.row_number().over(order) - 1)


def write_traces(samples: DataFrame, path: str, buckets: int = versions.BUCKETS) -> None:
    """The trace table; a lap that is written again replaces its samples. Laps lie together in parts by a hash of session and lap, of which only those that hold a written lap are rewritten, all in one commit."""
    rows = numbered(require_columns(samples, REQUIRED))
    versions.put(samples.sparkSession, path, [versions.Change("traces", rows, LAP)], buckets=buckets)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All laps; ``gear`` and ``clutch`` are null where they were written without."""
    rows = versions.read(spark, path, "traces")
    if rows is None:
        raise FileNotFoundError(f"no traces in {path}")
    for name in ("gear", "clutch"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(TRACE[name].dataType))
    return require_columns(rows, REQUIRED).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACE.fields))


def mixed_laps(rows: DataFrame) -> DataFrame:
    """Laps with more than one car, track or lap time."""
    return rows.groupBy(*LAP).agg(F.countDistinct("car_id").alias("cars"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("lap_time_ms").alias("times")).where("cars > 1 or tracks > 1 or times > 1")


_SAMPLE = "array<struct<progress:double,lap_distance_m:double,elapsed_seconds:double,speed_kmh:double,throttle:double,brake:double,steering_angle_deg:double>>"


def parse_exchange(texts: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """Samples of exchange files: a bare list, ``{"samples": [...]}``, or an object whose only field is the list."""
    bare = F.from_json(value, _SAMPLE)
    wrapped = F.from_json(value, f"samples {_SAMPLE}")["samples"]
    only = F.map_values(F.from_json(value, f"map<string,{_SAMPLE}>"))[0]
    start = F.ltrim(value)
    samples = F.when(start.startswith("["), bare).otherwise(F.coalesce(wrapped, only))
    return texts.select(name, F.posexplode(samples).alias("sample_index", "s")).select(name, "sample_index", "s.*")


FORMAT, FORMAT_VERSION = "lap-trace", 1


def refused_exchange(texts: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """(name, problem) of files that can't be imported: another format or version than ours where they state one, or no samples."""
    told = F.from_json(value, "format string, version int")
    empty = parse_exchange(texts, value, name).select(name).distinct().withColumn("__some", F.lit(True))
    joined = texts.select(name, told.alias("t"), F.ltrim(value).startswith("{").alias("o")).join(empty, name, "left")
    problem = (
        F.when(F.col("o") & (F.col("t.format") != FORMAT), "format").when(F.col("o") & (F.col("t.version") != FORMAT_VERSION), "version").when(F.col("__some").isNull(), "no_samples")
    )
    return joined.select(name, problem.alias("problem")).where("problem is not null")


def refused_pairs(pairs: DataFrame, places: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of files (ref, target) that aren't of the same car and track; ``places`` has name, car_id and track_id. Unknown ones count as different."""
    side = lambda n: places.select(F.col(name).alias(n), F.struct("car_id", "track_id").alias(f"__{n}"))
    joined = pairs.join(side("ref"), "ref", "left").join(side("target"), "target", "left")
    return joined.where(~F.coalesce(F.col("__ref") == F.col("__target"), F.lit(False))).select("ref", "target")


def export_exchange(trace: DataFrame) -> DataFrame:
    """Each lap as one JSON document with its format, version and samples in order."""
    sample = F.struct("sample_index", "progress", "elapsed_seconds", "speed_kmh", "throttle", "brake", "steering_angle_deg")
    document = F.struct(F.lit(FORMAT).alias("format"), F.lit(FORMAT_VERSION).alias("version"), F.array_sort(F.collect_list(sample)).alias("samples"))
    return trace.groupBy(*LAP).agg(F.to_json(document).alias("document"))


def normalize_distance(samples: DataFrame, name: str = "name", pair: tuple[str, ...] = ()) -> DataFrame:
    """Progress as distance over the longest one of the files compared, percent pedals as shares, and elapsed time estimated from speed where it is missing.

    Files whose distances don't grow from sample to sample give no rows.
    """
    w = Window.partitionBy(*pair, name).orderBy("sample_index")
    step = F.col("lap_distance_m") - F.lag("lap_distance_m").over(w)
    mean_speed = (F.col("speed_kmh") + F.lag("speed_kmh").over(w)) / 2 / 3.6
    whole = Window.partitionBy(*pair, name)
    marked = samples.withColumns({"__step": step, "__part": F.coalesce(F.try_divide(step, mean_speed), F.lit(0.0))})
    marked = marked.withColumns({"__ok": F.min(F.coalesce((F.col("__step") > 0).cast("int"), F.lit(1))).over(whole), "__percent": F.max(F.greatest("throttle", "brake")).over(whole) > 1.0})
    longest = samples.groupBy(*pair).agg(F.max("lap_distance_m").alias("__length"))
    if pair:
        marked, length = marked.join(longest, list(pair)), F.col("__length")
    else:  # one number for all
        length = longest.scalar()
    share = lambda c: F.when(F.col("__percent"), F.col(c) / 100).otherwise(F.col(c))
    elapsed = F.coalesce("elapsed_seconds", F.sum("__part").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("__ok = 1").withColumns({"progress": F.col("lap_distance_m") / length, "elapsed_seconds": elapsed, "throttle": share("throttle"), "brake": share("brake")}).drop("__step", "__part", "__ok", "__percent", "__length")
