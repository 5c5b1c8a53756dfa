"""Tables of a folder that change together: each commit is one small file that names the files of every table, so a reader sees all of a load or nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.storage import _at, delete, stored

#: Parts of a table that a change rewrites whole; a table keeps the number that it was begun with
BUCKETS = 64


class Conflict(RuntimeError):
    """Another commit came first: read again, then try again."""


@dataclass(frozen=True)
class Change:
    """Rows that take the place of all stored rows of their groups; with ``groups``, of those groups, also where no new row has one."""

    table: str
    rows: DataFrame
    group: tuple[str, ...]
    groups: DataFrame | None = None


def snapshot(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """The newest commit of a folder, or an older one that is still kept: its number, tables and what has been loaded."""
    files, at = _at(spark, f"{folder}/commits")
    numbers = [int(f.getPath().getName().partition(".")[0]) for f in files.listStatus(at) if not f.getPath().getName().startswith(".")] if files.exists(at) else []
    if not numbers:
        return {"number": 0, "tables": {}, "loads": {}}
    return json.loads(spark.read.text(_commit(folder, number or max(numbers)), wholetext=True).first()[0])


def _commit(folder: str, number: int) -> str:
    return f"{folder}/commits/{number:09d}.json"


def read(spark: SparkSession, folder: str, table: str, at: dict | None = None) -> DataFrame | None:
    """A table as of a snapshot, the newest by default; None before its first commit."""
    known = (at or snapshot(spark, folder))["tables"].get(table)
    if known is None:
        return None
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(known["schema"])
    paths = list(known["buckets"].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def put(spark: SparkSession, folder: str, changes: Sequence[Change], load: tuple[str, int] | None = None, buckets: int = BUCKETS, at_rest: bool = False) -> dict | None:
    """Commits all changes as one and returns the new snapshot. A ``load`` (source, number) is done once: None if the folder has that or a later one already.

    Only the buckets that hold a changed group are read and written, and the number of files grows with them and not with the
    groups. Readers keep the files of the snapshot they have read until ``expire``. Of two writers of one folder the second fails and leaves nothing visible.
    The rows are computed once, into a stored table; ``at_rest`` tells that they are read from one already.
    """
    before = snapshot(spark, folder)
    if load is not None and before["loads"].get(load[0], -1) >= load[1]:
        return None
    tables = dict(before["tables"])
    for change in changes:
        known = tables.get(change.table, {"buckets": {}, "count": buckets})
        bucket = F.pmod(F.xxhash64(*change.group), F.lit(known["count"])).cast("int")
        rows = change.rows if at_rest else stored(change.rows, change.table)
        groups = (change.groups if change.groups is not None else rows).select(*change.group).distinct()
        touched = {str(r[0]) for r in groups.select(bucket).distinct().collect()}  # at most as many as there are buckets
        kept = {b: p for b, p in known["buckets"].items() if b not in touched}
        old = [p for b, p in known["buckets"].items() if b in touched]
        merged = rows
        if old:
            merged = spark.read.parquet(*old).join(groups, list(change.group), "left_anti").unionByName(rows, allowMissingColumns=True)
        path = f"{folder}/data/{change.table}-{uuid.uuid4().hex}"
        placed = merged.withColumn("__bucket", bucket).hint("rebalance", "__bucket").sortWithinPartitions("__bucket", *change.group)
        placed.write.partitionBy("__bucket").parquet(path)
        files, at = _at(spark, path)
        made = [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()]
        schema = json.loads(merged.schema.json())
        tables[change.table] = {"count": known["count"], "schema": schema, "buckets": kept | {name.partition("=")[2]: f"{path}/{name}" for name in made}}
    after = {"number": before["number"] + 1, "tables": tables, "loads": before["loads"] | ({load[0]: load[1]} if load is not None else {})}
    _publish(spark, folder, after)
    return after


def _publish(spark: SparkSession, folder: str, after: dict) -> None:
    """The commit's file is written beside its place and moved there, which fails if the place is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files, final = _at(spark, _commit(folder, after["number"]))
    _, draft = _at(spark, f"{folder}/commits/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(after), "utf-8"))
    out.close()
    context = hadoop.FileContext.getFileContext(final.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri(), files.getConf())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise Conflict(f"commit {after['number']} of {folder} is taken") from error
        raise


def expire(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Deletes commits but the newest ones, and the files that none of those names. Not while a writer is at work: its files aren't named yet."""
    newest = snapshot(spark, folder)["number"]
    left = [snapshot(spark, folder, n) for n in range(max(1, newest - keep + 1), newest + 1)]
    named = {path for s in left for t in s["tables"].values() for path in t["buckets"].values()}
    for n in range(newest - keep, 0, -1):
        files, at = _at(spark, _commit(folder, n))
        if not files.exists(at):
            break
        files.delete(at, False)
    files, data = _at(spark, f"{folder}/data")
    for version in files.listStatus(data):
        for bucket in files.listStatus(version.getPath()):
            if bucket.isDirectory() and not any(p.endswith(f"{version.getPath().getName()}/{bucket.getPath().getName()}") for p in named):
                delete(spark, bucket.getPath().toString())
