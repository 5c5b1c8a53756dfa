"""Operator 12, best-fit packing: documents as token sequences of a fixed capacity, packed where they lie, then underfull bins merged up a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paddock.functions.storage import stored

from .byte_ids import byte_ids
from .common import fields, prepared, slices

CAPACITY, END = 1024, 2
#: A bin with at most this many free places leaves for good
NEARLY = 8
#: What a task packs together at most: pieces, and bytes of their ids
WINDOW_PIECES, WINDOW_BYTES = 200_000, 64_000_000
#: So many partitions of bins become one in each round, as long as one holds no more than so many bins
FAN_IN, ROUND_BINS = 8, 100_000
#: Rounds end when they merge less than this share of the open bins
LEAST_GAIN = 0.01
_PIECES = "piece int, start long, length long, ids_crc32 long, __bin long, offset long, __fill int"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: the longest items first, each to the open bin that it leaves the fewest places in.

    Open bins wait by their free places, and a bit for each number of places that has a bin finds the best one in one step.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    whole = int(np.count_nonzero(lengths == capacity))
    bins[order[:whole]] = np.arange(whole)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, whole
    into, at = [], []
    for length in lengths[order[whole:]].tolist():
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            waiting = open_bins[free]
            b = waiting.pop()
            if not waiting:
                mask ^= 1 << free
        else:
            free, b, made = capacity, made, made + 1
        into.append(b)
        at.append(capacity - free)
        free -= length
        if free:
            open_bins[free].append(b)
            mask |= 1 << free
    bins[order[whole:]], offsets[order[whole:]] = into, at
    return bins, offsets, np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of ``n`` tokens start and end; only the first may be shorter than the capacity."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


def _packed_where_it_lies(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], capacity: int, ids: bool, window: int) -> DataFrame:
    """Pieces of all documents in local bins: those of a task, or of a part of it that fits in memory."""
    new = fields(_PIECES + (", ids array<int>" if ids else ""))
    stay = [c for c in keep if c not in {f.name for f in new}]
    schema = T.StructType([*(docs.schema[c] for c in stay), *new])
    arrow = to_arrow_schema(schema)
    source = docs.select(*(F.col(f"`{c}`") for c in stay), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = prepared(lambda: byte_ids(path, plain=False)), np.array([END], "<u4").tobytes()
        base, bins_before = TaskContext.get().partitionId() << 36, 0
        held_pieces: list[list] = [[] for _ in range(5)]
        kept_columns: list[pa.RecordBatch] = []
        rows: list[int] = []
        size = held = 0

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal bins_before, size, held
            piece, start, length, crc, own = held_pieces
            lengths = np.array(length, np.int64)
            bins, offsets, fills = best_fit(lengths, capacity)
            columns = []
            if stay:
                table, row_of = pa.Table.from_batches(kept_columns), pa.array(rows, pa.int64())
                columns = [table.column(i).take(row_of).combine_chunks() for i in range(len(stay))]
            columns += [piece, start, lengths, crc, base + bins_before + bins, offsets, fills[bins]]
            arrays = [c if isinstance(c, pa.Array) else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)]
            if ids:
                values = np.frombuffer(b"".join(own), np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values)).cast(arrow.field(len(arrays)).type))
            bins_before += len(fills)
            out = pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], schema=arrow)
            for column in held_pieces:
                column.clear()
            kept_columns.clear()
            rows.clear()
            size = held = 0
            for at in range(0, out.num_rows, 10_000):
                yield out.slice(at, 10_000)

        for batch in batches:
            texts = batch.column(len(stay)).to_pylist()
            for first, last in slices(texts):
                kept_columns.append(batch.slice(first, last - first).select(list(range(len(stay)))) if stay else batch.slice(first, 0))
                for i in range(first, last):
                    raw = coder.packed(texts[i]) + end
                    bounds = cuts(len(raw) // 4, capacity)
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        part = raw[4 * a : 4 * b]
                        for column, value in zip(held_pieces, (k, a, b - a, zlib.crc32(part), part), strict=True):
                            if value is not part or ids:
                                column.append(value)
                        rows.append(held + i - first)
                    size += len(raw) if ids else 0
                held += last - first
                if len(rows) >= window or size >= WINDOW_BYTES:
                    yield from pack()
        if rows:
            yield from pack()

    return source.mapInArrow(run, schema)


def _merged(bins: DataFrame, capacity: int) -> DataFrame:
    """(bin, parent, shift, fill): best fit of the bins of each partition as items. A bin made of several has the id of the first in it."""
    schema = T.StructType.fromDDL("bin long, parent long, shift long, fill int")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=pa.schema([("bin", pa.int64()), ("fill", pa.int32())]))
        if not table.num_rows:
            return
        names, lengths = table.column("bin").to_numpy(), table.column("fill").to_numpy().astype(np.int64)
        into, shift, fills = best_fit(lengths, capacity)
        parent = np.zeros(len(fills), np.int64)
        parent[into[shift == 0]] = names[shift == 0]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(parent[into]), pa.array(shift), pa.array(fills[into].astype(np.int32))], schema=arrow)

    return bins.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, ids: bool = False, window: int = WINDOW_PIECES) -> DataFrame:
    """Every piece of every document with the sequence it is in and its offset there; with ``ids`` its token ids too.

    A document's ids are followed by id 2. One of at most ``capacity`` tokens is one piece; a longer one is cut into pieces of
    that length, of which the first may be shorter. Null and empty texts are one piece of one token. Sequences are filled without gaps from
    offset 0 and hold at most ``capacity`` tokens. Very long texts are cut whole; repeated rows are packed each; an
    empty table gives no rows. Of the input only the columns of ``keep`` stay, and one with the name of a new column gives way to it.

    Partitions are packed where they lie, and bins with at most 8 free places are done. The others are items of the next rounds, in which a task
    meets the bins of eight partitions of the round before, until one is left or a round merges less than 1 % of
    them. A task of a round holds two numbers of at most 100,000 bins or so.
    """
    pieces = stored(_packed_where_it_lies(docs, path, text, keep, capacity, ids, window), "pieces")
    is_open = F.col("__fill") < capacity - NEARLY
    bins = pieces.where(is_open & (F.col("offset") == 0)).select(F.col("__bin").alias("bin"), F.col("__fill").alias("fill"))
    rounds, parts, left = [], max(2, pieces.rdd.getNumPartitions()), bins.count()
    while parts > 1 and left > 1:
        fewer = max(-(-parts // FAN_IN), -(-left // ROUND_BINS))
        merged = stored(_merged(bins.repartition(fewer), capacity), "bins")
        rounds.append(merged.select("bin", "parent", "shift"))
        bins = merged.where((F.col("shift") == 0) & (F.col("fill") < capacity - NEARLY)).select("bin", "fill")
        still, gone = merged.agg(F.sum((F.col("shift") == 0).cast("long")), F.sum((F.col("shift") > 0).cast("long"))).first()
        if fewer == parts and gone < LEAST_GAIN * left or not still:
            break
        parts, left = fewer, bins.count()
    return _placed(pieces, is_open, rounds)


def _placed(pieces: DataFrame, is_open, rounds: list[DataFrame]) -> DataFrame:
    """Pieces with their last bin. Only those of underfull bins are joined, with the rounds' moves composed first."""
    shown = [c for c in pieces.columns if c not in ("__bin", "__fill", "offset", "ids")]
    ids = ["ids"] if "ids" in pieces.columns else []
    here = [F.col(f"`{c}`") for c in shown]
    if not rounds:
        return pieces.select(*here, F.col("__bin").alias("sequence_id"), "offset", *ids)

    def then(moves: DataFrame, later: DataFrame) -> DataFrame:
        later = later.select(F.col("bin").alias("parent"), F.col("parent").alias("__to"), F.col("shift").alias("__by"))
        return moves.join(later, "parent", "left").select("bin", F.coalesce("__to", "parent").alias("parent"), (F.col("shift") + F.coalesce("__by", F.lit(0))).alias("shift"))

    moves = reduce(then, rounds).select(F.col("bin").alias("__bin"), F.col("parent").alias("__parent"), F.col("shift").alias("__shift"))
    moved = pieces.where(is_open).join(moves, "__bin", "left")
    return pieces.where(~is_open).select(*here, F.col("__bin").alias("sequence_id"), "offset", *ids).unionByName(
        moved.select(*here, F.coalesce("__parent", "__bin").alias("sequence_id"), (F.col("offset") + F.coalesce("__shift", F.lit(0))).alias("offset"), *ids)
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of what ``pack`` with ``ids`` gives: one row per sequence, at most its capacity long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
