"""Lap traces: validation, coverage, as-of interpolation and alignment of pairs of laps."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.storage import stored

LAP = ("session_id", "lap_number")
PAIR = ("session_id", "ref_lap", "target_lap")
CHANNELS = ("elapsed_seconds", "speed_kmh", "throttle", "brake", "steering_angle_deg")


def violations(trace: DataFrame) -> DataFrame:
    """Samples that break a range or the order of their lap, with the reasons as an array."""
    w = Window.partitionBy(*LAP).orderBy("sample_index")
    outside = lambda c, low, high: F.coalesce(~F.col(c).between(low, high) | F.isnan(c), F.lit(True))
    reasons = {
        "progress": outside("progress", 0, 1), "throttle": outside("throttle", 0, 1), "brake": outside("brake", 0, 1), "elapsed": F.coalesce((F.col("elapsed_seconds") < 0) | F.isnan("elapsed_seconds"), F.lit(True)),
        "speed": F.coalesce((F.col("speed_kmh") < 0) | F.isnan("speed_kmh"), F.lit(True)), "steering": F.col("steering_angle_deg").isNull() | F.isnan("steering_angle_deg"),
        "clutch": F.coalesce(~F.col("clutch").between(0, 1), F.lit(False)), "gear": F.coalesce(F.col("gear") < -1, F.lit(False)),
        "progress_order": F.coalesce(F.col("progress") <= F.lag("progress").over(w), F.lit(False)), "elapsed_order": F.coalesce(F.col("elapsed_seconds") < F.lag("elapsed_seconds").over(w), F.lit(False)),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items())), lambda x: x.isNotNull())
    return trace.withColumn("reasons", found).where("size(reasons) > 0").select(*LAP, "sample_index", "reasons")


def availability(laps: DataFrame, traces: DataFrame, version: int = 1) -> DataFrame:
    """Why a lap's trace can't be used; null where it can. ``traces`` has schema_version, sample_count and file_path for each lap."""
    joined = laps.select(*LAP).join(traces.select(*LAP, "schema_version", "sample_count", "file_path"), list(LAP), "left")
    reason = (
        F.when(F.col("schema_version").isNull(), "missing_trace").when(F.col("schema_version") != version, "version_mismatch")
        .when(F.col("sample_count") < 2, "too_few_samples").when(F.col("file_path").isNull(), "missing_file")
    )
    return joined.select(*LAP, reason.alias("unavailable_reason"))


def coverage(trace: DataFrame) -> DataFrame:
    """Samples, ends and the largest gap in progress of each lap; of equal gaps the first."""
    w = Window.partitionBy(*LAP).orderBy("progress", "sample_index")
    gaps = trace.withColumn("__before", F.lag("progress").over(w)).withColumn("__gap", F.col("progress") - F.col("__before"))
    largest = F.max_by(F.struct("__gap", "__before", "progress"), F.when(F.col("__gap").isNotNull(), F.struct("__gap", (-F.col("progress")).alias("o"))))
    return gaps.groupBy(*LAP).agg(F.count(F.lit(1)).alias("samples"), F.min("progress").alias("start"), F.max("progress").alias("end"), largest.alias("g")).select(
        *LAP, "samples", "start", "end", F.col("g.__gap").alias("largest_gap"), F.col("g.__before").alias("gap_start"), F.col("g.progress").alias("gap_end")
    )


def shared_coverage(pairs: DataFrame, trace: DataFrame) -> DataFrame:
    """The stretch of track that both laps of a pair cover."""
    of = coverage(trace)
    side = lambda n: of.select("session_id", F.col("lap_number").alias(f"{n}_lap"), F.col("start").alias(f"{n}_start"), F.col("end").alias(f"{n}_end"))
    joined = pairs.join(side("ref"), ["session_id", "ref_lap"]).join(side("target"), ["session_id", "target_lap"])
    start, end = F.greatest("ref_start", "target_start"), F.least("ref_end", "target_end")
    return joined.select(*PAIR, start.alias("shared_start"), end.alias("shared_end"), F.greatest(F.lit(0.0), end - start).alias("shared_span"))


def unique_progress(trace: DataFrame) -> DataFrame:
    """One sample for each progress of a lap: the last in input order."""
    w = Window.partitionBy(*LAP, "progress").orderBy(F.desc("sample_index"))
    return trace.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def interpolate(probes: DataFrame, points: DataFrame, key: tuple[str, ...], position: str, channels: tuple[str, ...], clamp: bool = False, hold: tuple[str, ...] = (), tie: str | None = None, tasks: int | None = None) -> DataFrame:
    """``probes`` with the channels of ``points`` at their position, on the line between the points around it.

    An as-of join without a range join: probes and points of a key are shuffled together and sorted once; the last point at or before a
    probe and the next one after it come from the same window. Outside the points the channels are
    null, or with ``clamp`` those of the end point. Channels in ``hold`` keep the left point's value. With ``tie``, of points at one
    position only the one with the greatest value of that column counts. ``tasks`` is the number that the keys are dealt to, by default the session's.
    """
    carried = [c for c in probes.columns if c not in (*key, position)]
    point = F.struct(F.col(position).alias("x"), *channels, *([F.col(tie).alias("__tie")] if tie else []))
    kind = points.select(point.alias("s")).schema["s"].dataType.simpleString()
    rows = probes.select(*key, position, F.struct(F.lit(0).alias("__probe"), *carried).alias("__row"), F.lit(None).cast(kind).alias("__point"))
    empty = rows.schema["__row"].dataType.simpleString()
    rows = rows.unionByName(points.select(*key, position, F.lit(None).cast(empty).alias("__row"), point.alias("__point")))
    rows = rows if tasks is None else rows.repartition(tasks, *key)
    last = ("__point.__tie",) if tie else ()
    w = Window.partitionBy(*key).orderBy(position, F.col("__row").isNotNull(), *last)  # points before probes at their place
    order = f"PARTITION BY {', '.join(key)} ORDER BY {', '.join((position, '__row IS NOT NULL', *last))}"
    if tie:  # the same order, so no further sort
        after = F.lead(F.struct(position, F.col("__row").isNull())).over(w)
        rows = rows.withColumn("__later", after).where(f"__row is not null or __later is null or __later != struct({position}, true)").drop("__later")
    before = F.last("__point", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select("*", before.alias("__l"), F.expr(f"lead(__point, 1) IGNORE NULLS OVER ({order})").alias("__r")).where("__row is not null")
    left, right = F.col("__l"), F.col("__r")
    ratio = (F.col(position) - left["x"]) / (right["x"] - left["x"])

    def value(c: str) -> Column:
        inner = F.when(left["x"] == F.col(position), left[c]).when(left.isNotNull() & right.isNotNull(), left[c] if c in hold else left[c] + (right[c] - left[c]) * ratio)
        return F.coalesce(inner, F.when(left.isNull(), right[c]).when(right.isNull(), left[c])) if clamp else inner

    return placed.select(*key, position, *(F.col(f"__row.{c}").alias(c) for c in carried), *(value(c).alias(c) for c in channels))


#: So many pairs meet a reference lap's stretches under one key
PAIRS_TOGETHER = 256
#: So many samples, with the places to look up on their laps, are sorted in one task at a time, some 100 MB
SAMPLES_TOGETHER = 250_000


def stretches(trace: DataFrame) -> DataFrame:
    """Each lap cut between its samples, of equal progress the last: a row with the samples at either end (``l``, null before the first, and ``r``)."""
    w = Window.partitionBy(*LAP).orderBy("progress", "sample_index")
    sample = F.struct("progress", *CHANNELS)
    last = trace.select(*LAP, "progress", "sample_index", sample.alias("r"), F.lead("progress").over(w).alias("__next")).where("__next is null or __next != progress")
    return last.select(*LAP, F.lag("r").over(w).alias("l"), "r")


def _dealt(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Pairs that share a stretch, with its ends, and a number that deals out the pairs of a reference lap."""
    side = lambda n: ends.select("session_id", F.col("lap_number").alias(f"{n}_lap"), F.struct("start", "end").alias(n))
    both = pairs.join(side("ref"), ["session_id", "ref_lap"]).join(side("target"), ["session_id", "target_lap"])
    low, high = F.greatest("ref.start", "target.start"), F.least("ref.end", "target.end")
    shared = both.select(*PAIR, low.alias("low"), high.alias("high"), (high - low).alias("span")).where("span > 0")
    many = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("session_id", "ref_lap")) / PAIRS_TOGETHER)
    return stored(shared.withColumn("deal", F.pmod(F.xxhash64("target_lap"), many)), "pairs")


def _place(index: Column, points: int) -> Column:
    """Where on the track a grid point of a pair lies."""
    return F.when(index == points - 1, F.col("high")).otherwise(F.least("high", F.col("low") + F.col("span") / (points - 1) * index))


def align(pairs: DataFrame, trace: DataFrame, points: int = 201) -> DataFrame:
    """Both laps of each pair on a uniform grid of their shared progress, with target minus reference. Laps that share no stretch give no rows.

    A lap is cut once into the stretches between its samples, after one sort. A pair meets those of either lap by an equality join, and each stretch makes the grid points
    that lie on it; both laps' values of a grid point come together in an aggregation. A reference lap of many pairs is dealt out under as many keys as it takes, so that no task gets all of its session.
    """
    cut = stored(stretches(trace), "stretches")
    ends = cut.groupBy(*LAP).agg(F.min("r.progress").alias("start"), F.max("r.progress").alias("end"))
    key = ["session_id", "ref_lap"]
    dealt = _dealt(pairs, ends)
    reference = cut.withColumnRenamed("lap_number", "ref_lap").join(dealt.select(*key, "deal").distinct(), key)

    def on_grid(met: DataFrame, ref: bool) -> DataFrame:
        """Grid points on the stretches: their numbers by division, with one more on either side, then those that do lie on it."""
        step = F.col("span") / (points - 1)
        number = lambda c: ((F.col(c) - F.col("low")) / step).cast("int")
        first = F.col("l").isNull()  # of the first sample only the start can be a grid point
        least, most = F.when(first, 0).otherwise(F.greatest(F.lit(0), number("l.progress") - 1)), F.when(first, 0).otherwise(F.least(F.lit(points - 1), number("r.progress") + 1))
        placed = met.select(*PAIR, "low", "high", "span", "l", "r", F.explode(F.when(least <= most, F.sequence(least, most))).alias("grid_index"))
        placed = placed.withColumn("progress", _place(F.col("grid_index"), points)).where("progress = r.progress or (l.progress < progress and progress < r.progress)")
        ratio = (F.col("progress") - F.col("l.progress")) / (F.col("r.progress") - F.col("l.progress"))
        value = lambda c: F.when(F.col("progress") == F.col("r.progress"), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}") + (F.col(f"r.{c}") - F.col(f"l.{c}")) * ratio)
        sides = [(n, value if (n == "ref") == ref else lambda c: F.lit(None).cast("double")) for n in ("ref", "target")]
        return placed.select(*PAIR, "grid_index", "progress", *(of(c).alias(f"{n}_{c}") for n, of in sides for c in CHANNELS))

    rows = on_grid(dealt.join(reference, [*key, "deal"]), True).unionByName(on_grid(dealt.join(cut.withColumnRenamed("lap_number", "target_lap"), ["session_id", "target_lap"]), False))
    values = [f"{n}_{c}" for n in ("ref", "target") for c in CHANNELS]
    met = rows.groupBy(*PAIR, "grid_index").agg(F.max("progress").alias("progress"), *(F.max(v).alias(v) for v in values))
    delta = {f"{c}_delta": F.col(f"target_{c}") - F.col(f"ref_{c}") for c in CHANNELS}
    return met.withColumns(delta).withColumnRenamed("elapsed_seconds_delta", "time_delta_seconds")


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """Final time delta, mean speed delta, and where the target loses and gains the most speed (the first of equals)."""
    d = F.col("speed_kmh_delta")
    return aligned.groupBy(*PAIR).agg(
        F.max_by("time_delta_seconds", "grid_index").alias("final_time_delta_seconds"), F.avg(d).alias("mean_speed_delta_kmh"),
        F.min_by("progress", F.struct(d.alias("d"), F.col("grid_index"))).alias("largest_speed_loss_progress"), F.min_by("progress", F.struct((-d).alias("d"), F.col("grid_index"))).alias("largest_speed_gain_progress"),
    )


def time_delta_at(probes: DataFrame, aligned: DataFrame, position: str, name: str) -> DataFrame:
    """``probes`` with the pair's time delta at ``position`` as ``name``; null outside the shared stretch."""
    points = aligned.select(*PAIR, F.col("progress").alias(position), F.col("time_delta_seconds").alias(name))
    return interpolate(probes, points, PAIR, position, (name,))


def time_deltas(places: DataFrame, pairs: DataFrame, trace: DataFrame, points: int = 201) -> DataFrame:
    """What ``time_delta_at`` gives on the aligned pair at ``places`` (PAIR and position): these, each once, with time_delta_seconds; places outside the shared stretch are left out.

    Only the two grid points around a place are made, in place of the whole grid: their times on either lap come from one as-of
    interpolation, which sorts laps and grid points together. Reference laps are dealt out as in ``align``.
    """
    ends = stored(trace.groupBy(*LAP).agg(F.min("progress").alias("start"), F.max("progress").alias("end"), F.count(F.lit(1)).alias("samples")), "ends")
    tasks = math.ceil((ends.agg(F.sum("samples")).first()[0] or 1) / SAMPLES_TOGETHER)
    dealt = _dealt(pairs, ends)
    met = dealt.join(places.select(*PAIR, "position").distinct(), list(PAIR)).where("position between low and high")
    near = F.greatest(F.lit(0), F.least(F.lit(points - 1), ((F.col("position") - F.col("low")) / (F.col("span") / (points - 1))).cast("int")))
    # the division may be off by one on either side
    left = F.when((F.col("__near") < points - 1) & (_place(F.col("__near") + 1, points) <= F.col("position")), F.col("__near") + 1).when(_place(F.col("__near"), points) <= F.col("position"), F.col("__near")).otherwise(F.col("__near") - 1)
    around = met.withColumn("__near", near).withColumn("__left", left).withColumns({"__a": _place(F.col("__left"), points), "__b": _place(F.least(F.lit(points - 1), F.col("__left") + 1), points)})
    side = lambda lap, deal, end: F.struct(F.col(lap).alias("lap_number"), deal.alias("deal"), F.lit(lap).alias("of"), F.lit(end).alias("end"), F.col(end).alias("progress"))
    on_target = F.lit(-1).cast("long")
    needed = F.array(*(side(lap, deal, end) for lap, deal in (("ref_lap", F.col("deal")), ("target_lap", on_target)) for end in ("__a", "__b")))
    probes = around.select(*PAIR, "position", F.explode(needed).alias("n")).select("session_id", "ref_lap", "target_lap", "position", "n.*").where("`end` = '__a' or progress > position")
    # a lap's samples are needed once for each deal that it is a reference of, and once if it is a target
    copies = dealt.select("session_id", F.col("ref_lap").alias("lap_number"), "deal").unionByName(dealt.select("session_id", F.col("target_lap").alias("lap_number"), on_target.alias("deal"))).distinct()
    samples = trace.select(*LAP, "progress", "sample_index", "elapsed_seconds").join(copies, list(LAP))
    timed = interpolate(probes, samples, (*LAP, "deal"), "progress", ("elapsed_seconds",), tie="sample_index", tasks=tasks)
    pick = lambda lap, end: F.max(F.when((F.col("of") == lap) & (F.col("end") == end), F.col("elapsed_seconds")))
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("progress")))
    both = timed.groupBy(*PAIR, "position").agg(*((pick("target_lap", e) - pick("ref_lap", e)).alias(f"d{e}") for e in ("__a", "__b")), at("__a").alias("a"), at("__b").alias("b"))
    delta = F.when(F.col("a") == F.col("position"), F.col("d__a")).otherwise(F.col("d__a") + (F.col("d__b") - F.col("d__a")) * ((F.col("position") - F.col("a")) / (F.col("b") - F.col("a"))))
    return both.select(*PAIR, "position", delta.alias("time_delta_seconds"))


def live_delta(samples: DataFrame, reference: DataFrame, buckets: int = 256) -> DataFrame:
    """Samples with the time against their car's and track's reference lap at the same progress, or the reason why there is none.

    The reference lap's stretches between points are keyed by the parts of the track that they cross,
    and samples meet them by car, track and part: an equality join, whose keys don't gather the samples of a car and track.
    """
    key = ("car_id", "track_id")
    counts = reference.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*key).orderBy("progress")
    part = lambda c: F.floor(F.col(c) * buckets)
    points = reference.groupBy(*key, "progress").agg(F.max("elapsed_seconds").alias("__e"))
    stretches = points.select(*key, F.lag("progress").over(w).alias("__px"), F.lag("__e").over(w).alias("__pe"), F.col("progress").alias("__x"), "__e")
    parted = stretches.withColumn("__part", F.explode(F.sequence(part("__px"), part("__x")))).where("__px is not null")
    first = points.groupBy(*key).agg(F.min_by(F.struct("progress", "__e"), "progress").alias("f")).select(*key, F.lit(None).cast("double").alias("__px"), F.col("f.__e").alias("__pe"), F.col("f.progress").alias("__x"), F.col("f.__e").alias("__e"))
    ends = first.withColumn("__part", part("__x"))
    within = F.coalesce((F.col("__px") < F.col("progress")) & (F.col("progress") <= F.col("__x")), F.col("progress") == F.col("__x"))
    numbered = samples.withColumn("__part", part("progress"))
    placed = numbered.alias("s").join(
        parted.unionByName(ends).alias("r"), [F.col(f"s.{c}") == F.col(f"r.{c}") for c in (*key, "__part")] + [within], "left"
    ).select("s.*", "r.__px", "r.__pe", "r.__x", "r.__e").drop("__part")
    at = F.when(F.col("progress") == F.col("__x"), F.col("__e")).otherwise(F.col("__pe") + (F.col("__e") - F.col("__pe")) * ((F.col("progress") - F.col("__px")) / (F.col("__x") - F.col("__px"))))
    out = placed.withColumn("reference_seconds", at).drop("__px", "__pe", "__x", "__e").join(counts, list(key), "left")
    reason = F.when(F.col("__n").isNull(), "incompatible").when(F.col("__n") < 2, "too_few_samples").when(F.col("reference_seconds").isNull(), "not_covered")
    usable = F.when(reason.isNull(), F.col("elapsed_seconds") - F.col("reference_seconds"))
    return out.withColumns({"delta_seconds": usable, "unavailable_reason": reason}).drop("__n")


def resample(trace: DataFrame, times: DataFrame) -> DataFrame:
    """Each lap at given elapsed times, held at its ends; gear is the one before, clutch null where either side is."""
    channels = ("progress", "speed_kmh", "throttle", "brake", "steering_angle_deg", "gear", "clutch")
    return interpolate(times, trace.select(*LAP, "elapsed_seconds", *channels), LAP, "elapsed_seconds", channels, clamp=True, hold=("gear",))


def consistency(trace_catalog: DataFrame, sessions: DataFrame, laps: DataFrame, trace: DataFrame) -> DataFrame:
    """Traces whose car, track, lap time or sample count differs from the catalog's."""
    seen = trace.groupBy(*LAP).agg(F.first("car_id").alias("car_id"), F.first("track_id").alias("track_id"), F.count(F.lit(1)).alias("samples"))
    joined = (
        trace_catalog.select(*LAP, "sample_count", F.col("lap_time_ms").alias("trace_time_ms")).join(seen, list(LAP))
        .join(sessions.select("session_id", F.col("car_id").alias("session_car"), F.col("track_id").alias("session_track")), "session_id").join(laps.select(*LAP, "lap_time_ms"), list(LAP))
    )
    checks = {"car": F.col("car_id") != F.col("session_car"), "track": F.col("track_id") != F.col("session_track"), "lap_time": F.col("trace_time_ms") != F.col("lap_time_ms"), "sample_count": F.col("sample_count") != F.col("samples")}
    bad = reduce(lambda a, b: a | b, checks.values())
    return joined.where(bad).select(*LAP, F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull()).alias("mismatches"))
