"""Content fingerprints, and comparison of two versions of the same frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions import versions
from paddock.functions.scalars import hex_number
from paddock.functions.storage import stored
from paddock.operators.sessions import sql_summary

METRICS = (
    "duration_seconds", "maximum_speed_kmh", "average_speed_kmh", "average_front_pressure_psi", "average_rear_pressure_psi", "average_front_core_temp_c", "average_rear_core_temp_c",
    "average_front_brake_temp_c", "average_rear_brake_temp_c", "average_front_slip_angle_deg", "average_rear_slip_angle_deg", "valid_row_percentage",
)


def canonical(column: Column, kind: str) -> Column:
    """A value as text that tells all values of its type apart: its length and itself, or ``-`` for null; times in microseconds."""
    if kind in ("timestamp", "timestamp_ntz"):
        text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif kind.startswith(("struct", "array", "map")):
        text = F.to_json(F.struct(column), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    elif kind == "binary":
        text = F.hex(column)
    else:
        text = column.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fingerprint(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 of the schema with count, sum, least and greatest row hash; the order of rows and partitions doesn't matter.

    A row's hash is 60 bits of the MD5 of its values' texts, which any engine with MD5 can compute. An empty table gives no row, or with ``by`` no group.
    """
    columns = sorted(c for c in df.columns if c not in by)
    kinds = dict(df.dtypes)
    row = hex_number(F.md5(F.concat(*(canonical(F.col(f"`{c}`"), kinds[c]) for c in columns))))
    schema = ";".join(f"{c}:{kinds[c]}" for c in columns)
    sums = df.withColumn("__h", row).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("s"), F.min("__h").alias("lo"), F.max("__h").alias("hi"))
    return sums.where("rows > 0").select(*by, "rows", F.sha2(F.concat_ws("|", F.lit(schema), "rows", "s", "lo", "hi"), 256).alias("fingerprint"))


def quick_fingerprint(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Like ``fingerprint`` of each group, from two 64-bit hashes of a row in place of the MD5 of its values' texts: no value is made a text, and only Spark computes it.

    Which values are null is hashed too, since Spark's hash passes over nulls.
    """
    columns = sorted(c for c in df.columns if c not in by)
    kinds = dict(df.dtypes)
    value = lambda c: F.to_json(F.struct(F.col(f"`{c}`")), {"ignoreNullFields": "false"}) if "map<" in kinds[c] else F.col(f"`{c}`")
    nulls = [F.col(f"`{c}`").isNull() for c in columns]
    values = [value(c) for c in columns]
    rows = df.select(*by, F.xxhash64(F.lit(0), *values, *nulls).alias("__a"), F.xxhash64(F.lit(1), *reversed(values), *nulls).alias("__b"))
    schema = ";".join(f"{c}:{kinds[c]}" for c in columns)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(f"s{c}")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), total("__a"), total("__b"), F.min("__a").alias("lo"), F.max("__a").alias("hi"))
    return sums.select(*by, "rows", F.sha2(F.concat_ws("|", F.lit(schema), "rows", "s__a", "s__b", "lo", "hi"), 256).alias("fingerprint"))


def changed(current: DataFrame, manifest: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Keys whose fingerprint isn't the one in ``manifest``: the work still to do."""
    return current.join(manifest.select(*by, "fingerprint"), [*by, "fingerprint"], "left_anti").select(*by)


def refresh(frames: DataFrame, folder: str, table: str, compute: Callable[[DataFrame], DataFrame], version: int = 1, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Keeps ``compute(frames)``, with a row or more for each key of ``by``, as a stored table, and computes only what has changed; returns ``by`` and ``status``.

    The table's manifest has the (quick) fingerprint of the frames that each key was computed from, ``version`` (that of the computation) and the
    number of the commit. Keys whose fingerprint and version it has are ``skipped``: their frames are left out by an anti-join before
    anything is computed, and their stored rows aren't touched. The table and its manifest change in one commit, so a run that fails is done again.
    """
    spark, manifest = frames.sparkSession, f"{table}_manifest"
    at = versions.snapshot(spark, folder)
    now = stored(quick_fingerprint(frames, by).withColumn("version", F.lit(version)), "fingerprints")
    known = versions.read(spark, folder, manifest, at)
    work = now if known is None else now.join(known.select(*by, "fingerprint", "version"), [*by, "fingerprint", "version"], "left_anti")
    work = stored(work, "work")
    if not work.isEmpty():
        made = compute(frames.join(work.select(*by), list(by), "left_semi"))
        entries = work.select(*by, "rows", "fingerprint", "version", F.lit(at["number"] + 1).alias("made_in"))
        versions.put(spark, folder, [versions.Change(table, made, by, work.select(*by)), versions.Change(manifest, entries, by)])
    return now.select(*by).join(work.select(*by, F.lit("computed").alias("status")), list(by), "left").fillna("skipped", ["status"])


def compare(a: DataFrame, b: DataFrame, relative: float = 1e-6, absolute: float = 1e-6) -> DataFrame:
    """Per session: row counts, frames only one side has, metrics beyond tolerance, the largest difference, and the verdict.

    Sessions that only one side has aren't equal.
    """
    side = lambda df, n: sql_summary(df).select("session_id", F.col("sample_count").alias(f"{n}_rows"), *(F.col(m).alias(f"{n}_{m}") for m in METRICS))
    both = side(a, "a").join(side(b, "b"), "session_id", "full_outer")
    key = lambda df, n: df.select("session_id", "sample_index").distinct().withColumn(n, F.lit(True))
    only = key(a, "__a").join(key(b, "__b"), ["session_id", "sample_index"], "full_outer").groupBy("session_id").agg(F.sum((F.col("__a").isNull() | F.col("__b").isNull()).cast("long")).alias("unpaired_frames"))
    gap = lambda m: F.abs(F.col(f"a_{m}") - F.col(f"b_{m}"))
    close = lambda m: F.coalesce(gap(m) <= F.greatest(relative * F.greatest(F.abs(f"a_{m}"), F.abs(f"b_{m}")), F.lit(absolute)), F.col(f"a_{m}").isNull() & F.col(f"b_{m}").isNull())
    failed = reduce(lambda x, y: x + y, [(~close(m)).cast("int") for m in METRICS])
    out = both.join(only, "session_id").withColumns({"failed_metrics": failed, "maximum_difference": F.greatest(*(F.coalesce(gap(m), F.lit(0.0)) for m in METRICS))})
    equal = F.coalesce((F.col("a_rows") == F.col("b_rows")) & (F.col("unpaired_frames") == 0) & (F.col("failed_metrics") == 0), F.lit(False))
    return out.select("session_id", "a_rows", "b_rows", "unpaired_frames", "failed_metrics", "maximum_difference", equal.alias("is_equal"))
