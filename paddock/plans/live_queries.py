"""Queries over live feeds: what a source shows, and lap traces, in batch and over several micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.storage import folder
from paddock.operators import events
from paddock.plans.lap_queries import _CHANNELS, _LAP_TRACES, SNAPSHOT_SQL, snapshots
from paddock.plans.session_queries import query
from paddock.streaming import live, stages

#: Snapshots with states that nobody knows and values that aren't numbers among them
_ODD = f"SELECT *, CASE WHEN arrival % 37 = 5 THEN 'BROKEN' ELSE status END AS shown, arrival % 11 = 4 AS broken FROM ({SNAPSHOT_SQL})"
_ALONE = "CASE WHEN shown = 'BROKEN' THEN 'disconnected' WHEN shown = 'OFF' THEN 'waiting' WHEN broken THEN 'disconnected' WHEN shown = 'PAUSE' THEN 'paused' WHEN shown = 'REPLAY' THEN 'replay' ELSE 'live' END"
_FOLLOWED = (
    "list_reduce(list({'i': arrival, 'clock': seen_at_seconds, 'packet': packet_id, 'shown': shown, 'alone': alone, 'base': seen_at_seconds, 'open': alone NOT IN ('waiting', 'disconnected'), 'out': [alone]} ORDER BY arrival), "
    "lambda o, x: {'i': x.i, 'clock': x.clock, 'packet': x.packet, 'shown': x.shown, 'alone': x.alone, "
    "'base': CASE WHEN NOT o.open OR x.packet IS DISTINCT FROM o.packet OR x.shown = 'PAUSE' THEN x.clock ELSE o.base END, "
    "'open': x.alone NOT IN ('waiting', 'disconnected') AND NOT {stale}, 'out': list_append(o.out, CASE WHEN x.shown NOT IN ('BROKEN', 'OFF') AND {stale} THEN 'disconnected' ELSE x.alone END)})"
).replace("{stale}", "(o.open AND x.packet IS NOT DISTINCT FROM o.packet AND x.shown <> 'PAUSE' AND x.clock - o.base > 0.5e0)")
_STATES_SQL = (
    f"SELECT source_id, unnest(f.out) AS live_state, CAST(unnest(range(len(f.out))) AS BIGINT) AS arrival FROM (SELECT source_id, {_FOLLOWED} AS f "
    f"FROM (SELECT *, {_ALONE} AS alone FROM ({_ODD})) GROUP BY source_id)"
)


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).withColumns(
        {"status": F.when(F.col("arrival") % 37 == 5, "BROKEN").otherwise(F.col("status")), "speed_kmh": F.when(F.col("arrival") % 11 == 4, float("nan")).otherwise(F.col("speed_kmh"))}
    )


def _fed(spark: SparkSession, rows: DataFrame, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives that is stopped and begun again while the snapshots of each source arrive in four parts."""
    run = folder(spark, name)
    with live.keyed_state(spark):
        for part in range(4):
            rows.where(F.least(F.floor(F.col("arrival") / 20), F.lit(3)) == part).write.mode("append").parquet(f"{run}/in")
            stages.start(make(stages.read_stream(spark, f"{run}/in", rows.schema, 1000)), f"{run}/out", name).awaitTermination()
    return spark.read.parquet(f"{run}/out/{name}")


@query(_STATES_SQL)
def c9_live_state(spark, sf_dir):
    return events.live_state(_odd(spark, sf_dir), seconds=0.5).select("source_id", "arrival", "live_state")


@query(_STATES_SQL)
def h10_live_states(spark, sf_dir):
    """The same on a stream, whose state goes on from one micro-batch to the next."""
    return _fed(spark, _odd(spark, sf_dir), "states", lambda feed: live.live_states(feed, seconds=0.5, retry=0.0))


@query(
    "SELECT source_id, session_number, lap_number, CAST(lap_time_ms AS BIGINT) AS lap_time_ms, CAST(sample_index AS INTEGER) AS sample_index, "
    f"{', '.join(f's.{c} AS {c}' for c in _CHANNELS.split(', '))} FROM ({_LAP_TRACES})",
    _CHANNELS.replace(",", ""),
)
def h10_live_traces(spark, sf_dir):
    """Lap traces on a stream: laps that are open when a micro-batch ends are closed in a later one."""
    return _fed(spark, snapshots(spark, sf_dir), "traces", live.live_traces)
