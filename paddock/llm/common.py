"""Shared by the text operators: reading tables and mapping whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A slice of a batch holds so many characters at most, or one text.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What tasks of a worker keep for those after them (vocabularies, words met before), by name
_KEPT: dict = {}
_ASKED: set = set()


def kept(name, build: Callable):
    """What ``build`` makes, once in a worker for all tasks that ask for ``name``."""
    _ASKED.add(name)
    if name not in _KEPT:
        _KEPT[name] = build()
    return _KEPT[name]


def prepared(make: Callable):
    """``make()`` at the start of a task; what it doesn't ask for by ``kept`` is let go, so that stages don't pile up in a worker."""
    _ASKED.clear()
    made = make()
    for name in set(_KEPT) - _ASKED:
        del _KEPT[name]
    return made


def slices(texts: Sequence[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with ``most`` characters together at most, or of single texts."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    ddl: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Rows of ``df`` with the columns of ``ddl``, computed from the whole text of each.

    ``make()`` runs once in each task and returns a function from a list of texts to one
    sequence of values per new column. A null text counts as empty. Of the input only the
    columns of ``keep`` stay; one that has the name of a new column gives way to it.
    """
    new = fields(ddl)
    kept = [c for c in keep if c not in {f.name for f in new}]
    schema = T.StructType([*(f for c in kept for f in df.schema.fields if f.name == c), *new])
    arrow = to_arrow_schema(schema)
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepared(make)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for start, stop in slices(texts):
                made = work(texts[start:stop])
                columns = [batch.column(i).slice(start, stop - start).cast(arrow.field(i).type) for i in range(len(kept))]
                columns += [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(len(kept) + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each whole row in one column, ``__row``, beside its text: no new column can clash with one of the row's, whatever their names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("text"))


def held_out(doc_id: str = "doc_id"):
    """True for rows that no classifier learns from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of labelled rows that aren't held out, at most ``most`` of them.

    The bound makes the sample small enough to broadcast and for the driver; which rows it takes depends on a hash
    of the id alone. Of an id's texts it takes one, by a hash of the text, and of its labels the least. Rows without a label, id or text are left out.
    """
    key, mark = F.col(f"`{doc_id}`"), F.col(f"`{label}`").cast("int")
    chosen = (
        labels.select(key.alias("doc_id"), mark.alias("label"), held_out(doc_id).alias("held"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~F.col("held"))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(key.alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("doc_id", "text", "label")
