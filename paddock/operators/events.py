"""Sessions, laps, sectors and lap traces from ordered simulator snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OFF, REPLAY, LIVE, PAUSE = "OFF", "REPLAY", "LIVE", "PAUSE"


def _order(source: str, arrival: str):
    return Window.partitionBy(source).orderBy(arrival)


def sessionize(snapshots: DataFrame, source: str = "source_id", arrival: str = "arrival") -> DataFrame:
    """``is_new_session`` and a running ``session_number`` for each snapshot.

    A session starts at the first snapshot, when car, track or session type changes, when completed
    laps or the packet number fall, and when the status becomes LIVE after OFF or REPLAY.
    """
    w = _order(source, arrival)
    before = lambda c: F.lag(c).over(w)
    changed = lambda c: ~before(c).eqNullSafe(F.col(c))
    new = (
        before(arrival).isNull() | changed("car_model") | changed("track") | changed("session_type") | (F.col("completed_laps") < before("completed_laps"))
        | (F.col("packet_id") < before("packet_id")) | ((F.col("status") == LIVE) & before("status").isin(OFF, REPLAY))
    )
    marked = snapshots.withColumn("is_new_session", F.coalesce(new, F.lit(False)))
    return marked.withColumn("session_number", F.sum(F.col("is_new_session").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def progress_flags(sessions: DataFrame, source: str = "source_id", arrival: str = "arrival") -> DataFrame:
    """``lap_completed`` and ``sector_changed`` against the snapshot before, never on a session's first."""
    w = _order(source, arrival)
    flag = lambda cond: ~F.col("is_new_session") & F.coalesce(cond, F.lit(False))
    return sessions.withColumns(
        {
            "lap_completed": flag(F.col("completed_laps") > F.lag("completed_laps").over(w)),
            "sector_changed": flag(F.col("current_sector_index") != F.lag("current_sector_index").over(w)),
        }
    )


def lap_events(flags: DataFrame) -> DataFrame:
    """A row for each completed lap; it is the best if its time and the best time are positive and it isn't slower."""
    last, best = F.greatest(F.lit(0), F.col("last_time_ms")), F.greatest(F.lit(0), F.col("best_time_ms"))
    return flags.where("lap_completed").select(
        "source_id", "session_number", "arrival", F.col("completed_laps").alias("lap_number"), last.alias("lap_time_ms"), best.alias("best_lap_time_ms"), ((last > 0) & (best > 0) & (last <= best)).alias("is_best"), "position"
    )


def sector_events(flags: DataFrame, source: str = "source_id", arrival: str = "arrival") -> DataFrame:
    """A row for each finished sector: the one before the change, of the lap just closed or the current one."""
    w = _order(source, arrival)
    index = F.greatest(F.lit(0), F.lag("current_sector_index").over(w))
    lap = F.when(F.col("lap_completed"), F.greatest(F.lit(1), F.col("completed_laps"))).otherwise(F.col("completed_laps") + 1)
    return flags.withColumn("sector_index", index).where("sector_changed").select(
        "source_id", "session_number", "arrival", lap.alias("lap_number"), "sector_index", (F.col("sector_index") + 1).alias("sector_number"), F.greatest(F.lit(0), F.col("last_sector_time_ms")).alias("sector_time_ms"), "position"
    )


def stale(snapshots: DataFrame, seconds: float = 2.0, source: str = "source_id", arrival: str = "arrival", clock: str = "seen_at_seconds") -> DataFrame:
    """``unchanged_seconds`` since the packet number last changed, and ``is_stale`` at ``seconds`` or more."""
    w = _order(source, arrival)
    changed = ~F.lag("packet_id").over(w).eqNullSafe(F.col("packet_id"))
    since = F.last(F.when(changed, F.col(clock)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return snapshots.withColumn("unchanged_seconds", F.col(clock) - since).withColumn("is_stale", F.col("unchanged_seconds") >= seconds)


class Monitor:
    """Follows one source: what a reader that polls it would show at each snapshot.

    A source whose packet number stands still for more than ``seconds`` is given up, as is one with a status that
    nobody knows or a value that isn't a finite number; a pause counts as a change. What was given up is
    opened anew at the first snapshot at least ``retry`` seconds later, and shows until then what it showed.
    """

    def __init__(self, seconds: float = 2.0, retry: float = 0.0, known: tuple | None = None):
        self.seconds, self.retry = seconds, retry
        self.packet, self.changed_at, self.retry_at, self.opened, self.connected = known or (None, None, None, False, False)

    def known(self) -> tuple:
        """What must be kept to go on later."""
        return self.packet, self.changed_at, self.retry_at, self.opened, self.connected

    def lost(self, clock: float | None, state: str = "disconnected") -> str:
        self.packet, self.opened, self.retry_at = None, False, None if clock is None else clock + self.retry
        return state

    def step(self, clock: float, packet: int | None, status: str | None, broken: bool) -> str:
        if not self.opened:
            if self.retry_at is not None and clock < self.retry_at:
                return "disconnected" if self.connected else "waiting"
            self.opened, fresh = True, True
        else:
            fresh = packet != self.packet
        if status not in STATUS_SHOWN:
            return self.lost(clock)
        if status == OFF:
            return self.lost(clock, "waiting")
        if fresh or status == PAUSE:
            self.packet, self.changed_at = packet, clock
        elif clock - self.changed_at > self.seconds:
            return self.lost(clock)
        if broken:
            return self.lost(clock)
        self.connected = True
        return STATUS_SHOWN[status]


STATUS_SHOWN = {OFF: "waiting", REPLAY: "replay", LIVE: "live", PAUSE: "paused"}


def broken(snapshots: DataFrame) -> Column:
    """Whether a value of a snapshot isn't a finite number; a missing one isn't looked at."""
    found = F.lit(False)
    for f in snapshots.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            found = found | F.coalesce(F.isnan(f.name) | (F.abs(F.col(f"`{f.name}`")) == float("inf")), F.lit(False))
    return found


def live_state(snapshots: DataFrame, seconds: float = 2.0, source: str = "source_id", arrival: str = "arrival", clock: str = "seen_at_seconds", retry: float = 0.0) -> DataFrame:
    """``live_state`` of each snapshot: waiting, live, paused, replay or disconnected (see ``Monitor``).

    Whether a source is given up depends on when it was given up before, so its snapshots are followed in order; a task holds one source's state at a time.
    """
    columns = snapshots.columns
    schema = T.StructType([*snapshots.schema.fields, T.StructField("live_state", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, monitor = object(), None
        for batch in batches:
            states = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in (source, clock, "packet_id", "status", "__broken")), strict=True):
                if key != of:
                    of, monitor = key, Monitor(seconds, retry)
                states.append(monitor.step(*values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in columns), pa.array(states, pa.string())], schema=arrow)

    return snapshots.withColumn("__broken", broken(snapshots)).repartition(source).sortWithinPartitions(source, arrival).mapInArrow(run, schema)


def stepping_back(samples: DataFrame, key: list[str], order: str) -> DataFrame:
    """Samples with ``__back``: whether any sample of their lap has less progress or elapsed time than the one before. Of a lap without one all samples are accepted."""
    w = Window.partitionBy(*key)
    less = lambda c: F.coalesce(F.col(c) < F.lag(c).over(w.orderBy(order)), F.lit(False))
    stepped = samples.withColumn("__step", less("progress") | less("elapsed_seconds"))
    return stepped.withColumn("__back", F.max("__step").over(w)).drop("__step")


def _accept(samples: DataFrame, key: list[str], order: str) -> DataFrame:
    """Samples in order without those behind the last accepted one in elapsed time or progress; of equal progress the last stays.

    What was accepted last holds the greatest progress so far among the accepted, and its elapsed time. A sample that is behind in
    either is skipped, and doesn't raise the bar for the other; so a window that carries the pair of both
    maxima isn't enough where a lap steps back anywhere. Only such laps are folded in order in Python, whose state is the pair alone; nearly all
    others stay where they are.
    """
    schema = samples.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for frame in frames:
            keep = []
            for row in zip(*(frame[c] for c in (*key, "elapsed_seconds", "progress")), strict=True):
                *k, elapsed, progress = row
                k = tuple(k)
                if k not in state:
                    state = {k: (elapsed, progress)}  # sorted by key: only one is open
                    keep.append(True)
                    continue
                last_elapsed, last_progress = state[k]
                good = not (elapsed < last_elapsed or progress < last_progress)
                keep.append(good)
                if good:
                    state[k] = elapsed, progress
            yield frame[keep]

    marked = stepping_back(samples, key, order)
    folded = marked.where("__back").drop("__back").repartition(*key).sortWithinPartitions(*key, order).mapInPandas(run, schema)
    kept = marked.where("not __back").drop("__back").unionByName(folded)
    # of equal progress the last accepted
    last = F.lead("progress").over(Window.partitionBy(*key).orderBy(order))
    return kept.withColumn("__next", last).where("__next is null or __next != progress").drop("__next")


def lap_traces(sessions: DataFrame, least_samples: int = 3, start: float = 0.05, start_seconds: float = 5.0, end: float = 0.9) -> DataFrame:
    """Samples of complete laps, numbered, with the lap's time from the snapshot that closes it.

    Within a session a stretch of equal ``completed_laps`` is a lap. It is recorded if the stretch
    before had fewer laps, or it starts near the line; it is closed by a stretch with more laps. Only
    the samples of such stretches are looked at; no stretch is held in one row.
    """
    session = ["source_id", "session_number"]
    w = Window.partitionBy(*session).orderBy("arrival")
    marked = sessions.withColumn("__change", F.coalesce((F.col("completed_laps") != F.lag("completed_laps").over(w)).cast("int"), F.lit(0)))
    marked = marked.withColumn("__stretch", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "arrival")
    stretches = marked.groupBy(*session, "__stretch").agg(
        first("completed_laps").alias("laps"), first("progress").alias("p"), first("elapsed_seconds").alias("e"), first("last_time_ms").alias("first_last_time_ms")
    )
    by = Window.partitionBy(*session).orderBy("__stretch")
    near = (F.col("p") <= start) & (F.col("e") <= start_seconds)
    rose, closed = F.coalesce(F.lag("laps").over(by) < F.col("laps"), F.lit(False)), F.lead("laps").over(by) > F.col("laps")
    placed = stretches.withColumns({"__rose": rose, "__closed": closed, "lap_time_ms": F.lead("first_last_time_ms").over(by)})
    recorded = placed.where((F.col("__rose") | near) & F.col("__closed") & (F.col("lap_time_ms") > 0)).select(*session, "__stretch", (F.col("laps") + 1).alias("lap_number"), "lap_time_ms")
    key = [*session, "__stretch"]
    channels = ("progress", "elapsed_seconds", "speed_kmh", "throttle", "brake", "steering_angle_deg")
    kept = _accept(marked.select(*key, "arrival", *channels).join(recorded, key), key, "arrival")
    lap = Window.partitionBy(*key)
    numbered = kept.withColumns({"sample_index": F.row_number().over(lap.orderBy("arrival")) - 1, "__n": F.count(F.lit(1)).over(lap), "__low": F.min("progress").over(lap), "__high": F.max("progress").over(lap)})
    # progress never falls within a lap, so its ends are its least and its greatest
    whole = numbered.where((F.col("__n") >= least_samples) & (F.col("__low") <= start) & (F.col("__high") >= end))
    return whole.select(*session, "lap_number", "lap_time_ms", "sample_index", *channels)
