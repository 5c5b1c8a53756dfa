"""Tables that change together: whole groups, one commit a load, snapshots that readers keep, writers that come second, and incremental recomputation."""

import pytest
from pyspark.sql import functions as F

from paddock.functions import versions
from paddock.functions.storage import exists
from paddock.operators import catalog, parity

ROW = "k string, n int, v int"


def rows(spark, *items):
    return spark.createDataFrame(list(items), ROW)


def values(df):
    return sorted(map(tuple, df.collect()))


def test_groups_are_replaced_and_readers_keep_their_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda df, **more: versions.put(spark, path, [versions.Change("x", df, ("k",), **more)], buckets=4)
    assert versions.read(spark, path, "x") is None
    first = put(rows(spark, ("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("c", 1, 1)))
    before = versions.read(spark, path, "x")
    second = put(rows(spark, ("a", 3, 2)))
    assert values(before) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]
    assert values(versions.read(spark, path, "x")) == [("a", 3, 2), ("b", 1, 1), ("c", 1, 1)]
    kept = set(first["tables"]["x"]["buckets"].values()) & set(second["tables"]["x"]["buckets"].values())
    assert len(kept) == len(first["tables"]["x"]["buckets"]) - 1  # only the bucket of the group was written
    put(spark.createDataFrame([], ROW), groups=spark.createDataFrame([("b",)], "k string"))
    assert values(versions.read(spark, path, "x")) == [("a", 3, 2), ("c", 1, 1)]
    assert values(versions.read(spark, path, "x", versions.snapshot(spark, path, 1))) == values(before)
    versions.expire(spark, path, keep=1)
    assert values(versions.read(spark, path, "x")) == [("a", 3, 2), ("c", 1, 1)] and not exists(spark, f"{path}/commits/000000001.json")


def test_tables_change_together_and_the_second_writer_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.put(spark, path, [versions.Change("x", rows(spark, ("a", 1, 1)), ("k",)), versions.Change("y", rows(spark, ("a", 9, 9)), ("k", "n"))])
    stale = versions.snapshot(spark, path)
    versions.put(spark, path, [versions.Change("x", rows(spark, ("a", 2, 2)), ("k",))])
    monkeypatch.setattr(versions, "snapshot", lambda *_: stale)  # a writer that read before that commit
    with pytest.raises(versions.Conflict):
        versions.put(spark, path, [versions.Change("x", rows(spark, ("a", 3, 3)), ("k",)), versions.Change("y", rows(spark, ("a", 3, 3)), ("k", "n"))])
    monkeypatch.undo()
    assert values(versions.read(spark, path, "x")) == [("a", 2, 2)] and values(versions.read(spark, path, "y")) == [("a", 9, 9)]


def test_loads_are_done_once(spark, tmp_path):
    path = str(tmp_path / "c")
    laps = lambda *items: spark.createDataFrame(list(items), "session_id string, lap_number int, lap_time_ms int")
    order = [F.desc("lap_time_ms")]
    counts = catalog.load({"laps": laps(("s", 1, 10), ("s", 1, 11), ("s", 2, 20))}, path, order, ("live", 4))
    assert values(counts) == [("laps", 3)]
    assert catalog.load({"laps": laps(("s", 1, 99))}, path, order, ("live", 4)) is None  # delivered again
    assert catalog.load({"laps": laps(("s", 1, 98))}, path, order, ("live", 3)) is None
    assert values(catalog.loaded(spark, path, "laps")) == [("s", 1, 11), ("s", 2, 20)]
    assert catalog.load({"laps": laps(("s", 2, 5))}, path, order, ("other", 0)) is not None
    catalog.load({"laps": laps(("t", 1, 7))}, path, order)  # one without a number is always loaded
    assert values(catalog.loaded(spark, path, "laps")) == [("s", 1, 11), ("s", 2, 5), ("t", 1, 7)]


def test_only_changed_keys_are_computed(spark, tmp_path):
    path, asked = str(tmp_path / "g"), []

    def compute(frames):
        asked.append(sorted(r[0] for r in frames.select("session_id").distinct().collect()))
        return frames.groupBy("session_id").agg(F.sum("v").alias("total"))

    frames = lambda *items: spark.createDataFrame(list(items), "session_id string, v int")
    refresh = lambda df, version=1: values(parity.refresh(df, path, "gold", compute, version))
    assert refresh(frames(("a", 1), ("a", 2), ("b", 3))) == [("a", "computed"), ("b", "computed")]
    assert refresh(frames(("a", 2), ("b", 3), ("a", 1))) == [("a", "skipped"), ("b", "skipped")]  # another order isn't a change
    assert refresh(frames(("a", 1), ("a", 2), ("b", 4), ("c", 5))) == [("a", "skipped"), ("b", "computed"), ("c", "computed")]
    assert asked == [["a", "b"], ["b", "c"]]
    assert values(versions.read(spark, path, "gold")) == [("a", 3), ("b", 4), ("c", 5)]
    assert {r.session_id: r.made_in for r in versions.read(spark, path, "gold_manifest").collect()} == {"a": 1, "b": 2, "c": 2}
    assert refresh(frames(("a", 1), ("a", 2)), version=2) == [("a", "computed")]
