"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Most rows of a stored file. Tables that compress well would else be read by a few tasks, each with far more rows than its bytes tell; Spark counts a file as 4 MB or more when it deals files to tasks
ROWS_PER_FILE = 200_000
#: Paths that the open scopes delete, the innermost last; each thread and task of the driver has its own
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session that has none gets a temporary one, any other fails, since its executors couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="paddock-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def create(spark: SparkSession, path: str) -> None:
    """An empty folder, if there is none."""
    files, at = _at(spark, path)
    files.mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table or a partition of one, wherever it is stored."""
    files, at = _at(spark, path)
    files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables stored inside when it ends. What is still to be read must be written by then."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            delete(spark, path)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the innermost ``scratch`` ends; without one it stays."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again: later stages plan and compute from there, also after an executor is lost.

    The table stays until the innermost ``scratch`` ends, or with ``keep`` until someone deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    if not keep and (scopes := _SCOPES.get()):
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
