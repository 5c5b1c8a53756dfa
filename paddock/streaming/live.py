"""Unbounded feeds of snapshots: lap and sector events, lap traces, and what each source shows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paddock.operators.events import LIVE, OFF, REPLAY, Monitor, broken

_KEPT = ("arrival", "packet_id", "status", "car_model", "track", "session_type", "completed_laps", "current_sector_index")
STATE = "session_number long, arrival long, packet_id long, status string, car_model string, track string, session_type string, completed_laps long, current_sector_index long"
OUTPUT = "source_id long, session_number long, arrival long, kind string, lap_number long, sector_number long, time_ms long, is_best boolean"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
CHANNELS = ("progress", "elapsed_seconds", "speed_kmh", "throttle", "brake", "steering_angle_deg")
_DOUBLES = ", ".join(f"{c} double" for c in CHANNELS)
TRACES = f"source_id long, session_number long, lap_number long, lap_time_ms long, sample_index int, {_DOUBLES}"
STATES = "source_id long, arrival long, live_state string"


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A source's snapshots of one micro-batch by arrival. A shuffle doesn't keep their order, so they are sorted together; the trigger's limit on files or offsets bounds them."""
    return pd.concat(list(batches)).sort_values("arrival", kind="stable")


def _flags(rows: pd.DataFrame, first_is_new: bool) -> pd.DataFrame:
    """Session starts, finished laps and sectors of snapshots in order; the first row is the one before, or the feed's first."""
    before = rows.shift(1)
    new = (rows["completed_laps"] < before["completed_laps"]) | (rows["packet_id"] < before["packet_id"]) | ((rows["status"] == LIVE) & before["status"].isin([OFF, REPLAY]))
    for c in ("car_model", "track", "session_type"):
        new |= (rows[c] != before[c]) & ~(rows[c].isna() & before[c].isna())
    new.iloc[0] = first_is_new
    both = before["current_sector_index"].notna() & rows["current_sector_index"].notna()
    return rows.assign(new=new, lap=~new & (rows["completed_laps"] > before["completed_laps"]), sector=~new & both & (rows["current_sector_index"] != before["current_sector_index"]), sector_before=before["current_sector_index"])


def _plain(value):
    """A cell of a frame as the state takes it."""
    return None if pd.isna(value) else value if isinstance(value, str) else int(value)


def _events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        number, arrival, *_ = state.get
        yield pd.DataFrame([[key[0], number, arrival, "disconnected", None, None, None, None]], columns=_NAMES)
        state.remove()
        return
    rows = _ordered(batches)
    known = state.exists
    number = 0
    if known:
        number, *last = state.get
        rows = pd.concat([pd.DataFrame([last], columns=list(_KEPT)), rows[rows["arrival"] > last[0]]], ignore_index=True)
    marked = _flags(rows, not known)
    marked["session_number"] = number + marked["new"].cumsum()
    seen = marked.iloc[1:] if known else marked
    laps, sectors = seen[seen["lap"]], seen[seen["sector"]]
    last_ms, best_ms = laps["last_time_ms"].clip(lower=0), laps["best_time_ms"].clip(lower=0)
    out = [
        pd.DataFrame({"session_number": laps["session_number"], "arrival": laps["arrival"], "kind": "lap", "lap_number": laps["completed_laps"], "sector_number": None, "time_ms": last_ms, "is_best": (last_ms > 0) & (best_ms > 0) & (last_ms <= best_ms)}),
        pd.DataFrame(
            {
                "session_number": sectors["session_number"], "arrival": sectors["arrival"], "kind": "sector", "lap_number": sectors["completed_laps"].where(sectors["lap"], sectors["completed_laps"] + 1).clip(lower=1),
                "sector_number": sectors["sector_before"].clip(lower=0) + 1, "time_ms": sectors["last_sector_time_ms"].clip(lower=0), "is_best": None,
            }
        ),
    ]
    tail = marked.iloc[-1]
    state.update((int(tail["session_number"]), *(_plain(tail[c]) for c in _KEPT)))
    yield from (df.assign(source_id=key[0])[_NAMES] for df in out if len(df))


def live_events(snapshots: DataFrame, source: str = "source_id", lost_after_ms: int | None = None) -> DataFrame:
    """Events of each source as its snapshots come in: finished laps and sectors, and with ``lost_after_ms`` a source that falls silent.

    The state of a source is its last snapshot and its session number, whatever the length of the feed.
    Snapshots that come after later ones of their source are left out.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if lost_after_ms else GroupStateTimeout.NoTimeout

    def step(key, batches, state):
        yield from _events(key, batches, state)
        if lost_after_ms and state.exists:
            state.setTimeoutDuration(lost_after_ms)

    return snapshots.groupBy(source).applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams begun inside keep their state in RocksDB, which lists and timers need."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _starts_session(row, before: tuple | None) -> bool:
    """The rule of ``events.sessionize`` for one snapshot after another; a missing number starts none."""
    if before is None:
        return True
    packet, status, car, track, kind, laps = before
    fell = lambda now, then: now is not None and then is not None and now < then
    return (row.car_model, row.track, row.session_type) != (car, track, kind) or fell(row.completed_laps, laps) or fell(row.packet_id, packet) or (row.status == LIVE and status in (OFF, REPLAY))


class _Traces(StatefulProcessor):
    """Lap traces of one source. Its state is the last snapshot, the lap that is open and that lap's accepted samples.

    The last accepted sample waits in the value, since one of equal progress replaces it; those before it are in the list.
    """

    def __init__(self, least_samples: int, start: float, start_seconds: float, end: float, silent_ms: int | None):
        self.limits, self.silent_ms = (least_samples, start, start_seconds, end), silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "session_number long, arrival long, packet_id long, status string, car_model string, track string, session_type string, completed_laps long")
        self.lap = handle.getValueState("lap", f"lap_number long, {_DOUBLES}")
        self.samples = handle.getListState("samples", _DOUBLES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows)
        number, arrival, *before = self.last.get() if self.last.exists() else (0, None, None)
        before = tuple(before) if arrival is not None else None
        lap, *pending = self.lap.get() if self.lap.exists() else (None,)
        pending, fresh, least, near, near_seconds, end = tuple(pending) or None, [], *self.limits
        if arrival is not None:
            frame = frame[frame["arrival"] > arrival]
        for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
            new, sample = _starts_session(row, before), tuple(None if (v := getattr(row, c)) is None else float(v) for c in CHANNELS)
            laps_before, arrival = None if new or before is None else before[-1], int(row.arrival)
            if new:
                number += 1
                lap, pending = self._dropped(fresh)
            if row.completed_laps is not None and laps_before is not None and row.completed_laps > laps_before:
                if lap is not None:
                    trace = [*(self.samples.get() if self.samples.exists() else ()), *fresh, *([pending] if pending else ())]
                    if len(trace) >= least and trace[0][0] <= near and trace[-1][0] >= end and (row.last_time_ms or 0) > 0:
                        made = pd.DataFrame([tuple(s) for s in trace], columns=list(CHANNELS))
                        yield made.assign(source_id=key[0], session_number=number, lap_number=lap, lap_time_ms=int(row.last_time_ms), sample_index=range(len(made)))[[c.split()[0] for c in TRACES.split(", ")]]
                self._dropped(fresh)
                lap, pending = int(row.completed_laps) + 1, None
            elif laps_before is None and row.completed_laps is not None and None not in sample[:2] and sample[0] <= near and sample[1] <= near_seconds:
                lap, pending = int(row.completed_laps) + 1, None
            if lap is not None and None not in sample[:2]:
                if pending is None or (sample[1] >= pending[1] and sample[0] > pending[0]):
                    fresh += [pending] if pending else []
                    pending = sample
                elif sample[1] >= pending[1] and sample[0] == pending[0]:
                    pending = sample
            laps_now = row.completed_laps if row.completed_laps is not None else laps_before
            before = tuple(_plain(v) for v in (row.packet_id, row.status, row.car_model, row.track, row.session_type, laps_now))
        if arrival is None or before is None:
            return
        self.last.update((number, arrival, *before))
        if fresh:
            self.samples.appendList(fresh)
        if lap is None:
            self.lap.clear()
        else:
            self.lap.update((lap, *(pending or (None,) * len(CHANNELS))))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(int(frame["seen_time"].max().timestamp() * 1000) if len(frame) else 0, timerValues.getCurrentWatermarkInMs()) + self.silent_ms)

    def _dropped(self, fresh: list) -> tuple[None, None]:
        self.samples.clear()
        fresh.clear()
        return None, None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The source has been silent: its open lap won't be whole any more."""
        self.samples.clear()
        self.lap.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_traces(
    snapshots: DataFrame, source: str = "source_id", least_samples: int = 3, start: float = 0.05, start_seconds: float = 5.0, end: float = 0.9, seen_at: str | None = None, watermark: str = "1 hour", silent_seconds: int = 3600
) -> DataFrame:
    """Samples of complete laps as soon as the snapshot that closes a lap comes in: the rows of ``events.lap_traces`` over ``events.sessionize``.

    A source's state is at most one lap. With ``seen_at``, a timestamp column, the open lap of a source is dropped once the
    feed's watermark (``watermark`` behind the latest snapshot of all sources) is ``silent_seconds`` past its last one; snapshots
    older than the watermark are late and left out. Snapshots that come after later ones of their source are left out. Begin the stream inside ``keyed_state``.
    """
    silent = None if seen_at is None else silent_seconds * 1000
    if seen_at is not None:
        snapshots = snapshots.withColumn("seen_time", F.col(seen_at)).withWatermark("seen_time", watermark)
    return snapshots.groupBy(source).transformWithStateInPandas(_Traces(least_samples, start, start_seconds, end, silent), TRACES, "append", "none" if silent is None else "eventTime")


class _States(StatefulProcessor):
    """What one source shows; its state is that of its monitor. A timer tells when nothing has come for too long."""

    def __init__(self, seconds: float, retry: float, clock: str, silent_ms: int | None):
        self.seconds, self.retry, self.clock, self.silent_ms = seconds, retry, clock, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "arrival long, packet long, changed_at double, retry_at double, opened boolean, connected boolean, clock double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows)
        arrival, *known, clock = self.known.get() if self.known.exists() else (None, None)
        monitor = Monitor(self.seconds, self.retry, tuple(known) or None)
        if arrival is not None:
            frame = frame[frame["arrival"] > arrival]
        out = []
        for arrived, clock, packet, status, bad in zip(*(frame[c] for c in ("arrival", self.clock, "packet_id", "status", "broken_value")), strict=True):
            arrival, clock = int(arrived), float(clock)
            out.append((key[0], arrival, monitor.step(clock, _plain(packet), None if pd.isna(status) else status, bool(bad))))
        if out:
            self.known.update((arrival, *monitor.known(), clock))
            yield pd.DataFrame(out, columns=["source_id", "arrival", "live_state"])
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No snapshot has come: the source is gone until one does."""
        if not self.known.exists():
            return
        arrival, *known, clock = self.known.get()
        monitor = Monitor(self.seconds, self.retry, tuple(known))
        if monitor.opened:
            monitor.lost(clock)
            self.known.update((arrival, *monitor.known(), clock))
            yield pd.DataFrame([(key[0], arrival, "disconnected")], columns=["source_id", "arrival", "live_state"])

    def close(self) -> None:
        pass


def live_states(snapshots: DataFrame, seconds: float = 2.0, retry: float = 2.0, source: str = "source_id", clock: str = "seen_at_seconds", silent_ms: int | None = None) -> DataFrame:
    """(source_id, arrival, live_state) of each snapshot as it comes in (see ``events.Monitor``), and with ``silent_ms`` one row more, disconnected, for a source from which nothing has come for so long by the clock of the cluster; such a stream goes on until it is stopped, also under ``availableNow``.

    Snapshots that come after later ones of their source are left out. Begin the stream inside ``keyed_state``.
    """
    return snapshots.withColumn("broken_value", broken(snapshots)).groupBy(source).transformWithStateInPandas(_States(seconds, retry, clock, silent_ms), STATES, "append", "none" if silent_ms is None else "processingTime")
