"""Plain tables: CSV and Parquet data sets, JSON catalogs, published batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.schemas import require_columns


def read_dataset(spark: SparkSession, path: str, columns: tuple[str, ...], schema: T.StructType | None = None) -> DataFrame:
    """The given columns of a CSV or Parquet data set, without rows that lack one of them."""
    rows = spark.read.option("header", True).option("inferSchema", schema is None).csv(path, schema=schema) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return require_columns(rows, columns, path).select(*columns).dropna()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_catalog(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON objects of a folder, or JSON lines."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def get(catalog: DataFrame, key: str, value) -> DataFrame:
    """The one row of a catalog under an id; raises if there is none."""
    found = catalog.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(f"no {key} {value!r}")
    return found


def append_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def mixed_batches(batch: DataFrame, by: str) -> DataFrame:
    """Batches with more than one session, car or track: they may not be published."""
    return batch.groupBy(by).agg(F.countDistinct("session_id", "car_id", "track_id").alias("identities")).where("identities > 1")


def publish(batch: DataFrame, path: str) -> None:
    """Appends a batch of one session, car and track; its files appear together when the write is done. An empty or mixed batch raises and writes nothing."""
    identities = batch.select("session_id", "car_id", "track_id").distinct().limit(2).collect()
    if len(identities) != 1:
        raise ValueError("a batch must hold frames of one session, car and track")
    batch.write.mode("append").parquet(path)
