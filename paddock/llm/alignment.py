"""Operator 13, cross-tokenizer alignment: windows between shared word starts, aligned once for each pair of id tuples, and how common each link is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paddock.functions.storage import stored

from .byte_ids import byte_ids
from .common import fields, kept, prepared, slices

SPACE = "▁"
#: Words that a worker remembers the pieces of, and windows that it remembers the alignment of, at most; longer ones are done anew each time
MOST_WORDS, MOST_WORD_CHARS, MOST_WINDOWS, MOST_WINDOW_BYTES = 400_000, 64, 300_000, 256
#: Characters of documents that are aligned together, and of those that share one list of id pairs
SLICE_CHARS, CHUNK_CHARS = 2_000_000, 8_000_000
#: Links of a group beyond which its id pairs are counted instead of listed
LARGE_GROUP = 256
_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class PieceIds:
    """Encodes texts as the sentencepiece library does; words between single spaces come from a bounded cache, since no piece reaches over a space."""

    def __init__(self, path: str):
        import sentencepiece

        lib = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("needs spaces only at the start of pieces")
            self.raw.append(bytes([int(piece[3:5], 16)]) if lib.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.length = np.array([len(r) for r in self.raw], np.int64)
        self.cache: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text as 32-bit numbers, or None where its pieces don't read a space and the text."""
        split = [self._words(t) for t in texts]
        cache = self.cache
        new = list(dict.fromkeys(w for words in split if words for w in words if w not in cache))
        fresh = dict(zip(new, self._right(new), strict=True))
        out: list[bytes | None] = []
        for text, words in zip(texts, split, strict=True):
            parts = [cache.get(w) or fresh.get(w) for w in words] if words else [None]
            if None not in parts:
                out.append(b"".join(parts))
                continue
            ids = self.library.encode(text)
            out.append(np.array(ids, "<u4").tobytes() if self._read(ids) == b" " + text.encode() else None)
        for word, ids in fresh.items():
            if len(cache) >= MOST_WORDS:
                break
            if ids is not None and len(word) <= MOST_WORD_CHARS:
                cache[word] = ids
        return out

    def _right(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word if their pieces read a space and the word."""
        each = self.library.encode(words, num_threads=1)
        bounds = np.cumsum([0, *map(len, each)])
        flat = np.fromiter(chain.from_iterable(each), "<u4", int(bounds[-1]))
        ends = np.r_[0, np.cumsum(self.length[flat])][bounds].tolist()
        packed, text, at = flat.tobytes(), b"".join(map(self.raw.__getitem__, flat.tolist())), (4 * bounds).tolist()
        return [packed[i:j] if text[x:y] == b" " + w.encode() else None for w, i, j, x, y in zip(words, at, at[1:], ends, ends[1:], strict=False)]

    def _read(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    @staticmethod
    def _words(text: str) -> list[str] | None:
        words = text.split(" ")
        return words if all(words) else None


class Aligner:
    """Aligns the ids of two tokenizers of a text. What it knows of a window it looks up by the two tuples of ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_ids(path_a, plain=True), PieceIds(path_b)
        size_a = max(self.a.raw) + 1
        #: A pair of ids as one number
        self.base = len(self.b.raw)
        self.length_a = np.array([len(self.a.raw.get(i, b"")) for i in range(size_a)], np.int64)
        self.length_b = self.b.length
        self.spaced_a = np.array([self.a.raw.get(i, b"")[:1] == b" " for i in range(size_a)])
        self.spaced_b = np.array([r[:1] == b" " for r in self.b.raw])
        #: Ids as they are shown, by what follows
        self.shown_a = np.array([[f"{i}{after}" for i in range(size_a)] for after in ",|"], object)
        self.shown_b = np.array([[f"{i}{after}" for i in range(len(self.b.raw))] for after in ",;\n"], object)
        self.forget()

    def forget(self) -> None:
        """Windows: number by ids; text, groups and links of each; and the links' id pairs with the times each occurs, of all windows in a row."""
        self.memo: dict[tuple[bytes, bytes], int] = {}
        self.pending: list[tuple[bytes, bytes]] = []
        self.text: list[str] = []
        self.groups = self.links = np.zeros(0, np.int64)
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self) -> None:
        """Aligns the windows that are new, all in a row: both sides of each read as many bytes, so that a group ends where both sides' running ends are equal."""
        if not self.pending:
            return
        packed_a, packed_b = [k[0] for k in self.pending], [k[1] for k in self.pending]
        a, b = np.frombuffer(b"".join(packed_a), "<u4").astype(np.int64), np.frombuffer(b"".join(packed_b), "<u4").astype(np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        many_a, many_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        last_group = group_a[np.cumsum([len(x) // 4 for x in packed_a]) - 1]  # of each window
        self.groups = np.r_[self.groups, np.diff(last_group, prepend=-1)]
        product = np.cumsum(many_a * many_b)
        self.links = np.r_[self.links, np.diff(product[last_group], prepend=0)]
        # every token with what follows it: a comma in a group, a bar between its sides, then a semicolon or the end of the window
        flat = np.empty(len(a) + len(b), object)
        ended_a, ended_b = np.r_[group_a[1:] != group_a[:-1], True], (np.r_[group_b[1:] != group_b[:-1], True]).astype(np.int64)
        ended_b[np.cumsum([len(x) // 4 for x in packed_b]) - 1] = 2
        flat[np.arange(len(a)) + first_b[group_a]] = self.shown_a[ended_a.astype(np.int64), a]
        flat[np.arange(len(b)) + (first_a + many_a)[group_b]] = self.shown_b[ended_b, b]
        self.text += "".join(flat.tolist()).split("\n")[:-1]
        # links: each A token with all B tokens of its group; a large group gives each pair of ids once
        large = many_a * many_b > LARGE_GROUP
        row = np.flatnonzero(~large[group_a])
        reach = many_b[group_a[row]]
        other = np.repeat(first_b[group_a[row]] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        group, pair = np.repeat(group_a[row], reach), np.repeat(a[row], reach) * self.base + b[other]
        times = np.ones(len(pair), np.int64)
        for g in np.flatnonzero(large).tolist():
            ids_a, of_a = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            ids_b, of_b = np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            own = (ids_a[:, None] * self.base + ids_b).ravel()
            group, pair, times = np.r_[group, np.full(len(own), g)], np.r_[pair, own], np.r_[times, (of_a[:, None] * of_b).ravel()]
        if large.any():
            order = np.argsort(group, kind="stable")
            group, pair, times = group[order], pair[order], times[order]
        self.starts = np.r_[self.starts, len(self.pairs) + np.searchsorted(group, last_group, side="right")]
        self.pairs, self.times = np.r_[self.pairs, pair], np.r_[self.times, times]
        self.pending = []

    def windows(self, packed_a: bytes, packed_b: bytes) -> list[int]:
        """Numbers of a document's windows. They meet where a token of each side ends and the next one of each starts with a space."""
        a, b = np.frombuffer(packed_a, "<u4"), np.frombuffer(packed_b, "<u4")
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        if ends_a[-1] != ends_b[-1]:
            raise ValueError("the tokens of both sides must read the same text")
        at_a, at_b = np.flatnonzero(self.spaced_a[a[1:]]) + 1, np.flatnonzero(self.spaced_b[b[1:]]) + 1
        _, own_a, own_b = np.intersect1d(ends_a[at_a - 1], ends_b[at_b - 1], assume_unique=True, return_indices=True)
        cut_a, cut_b = [0, *(4 * at_a[own_a]).tolist(), len(packed_a)], [0, *(4 * at_b[own_b]).tolist(), len(packed_b)]
        memo, pending, known, out = self.memo, self.pending, len(self.text), []
        for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False):
            key = packed_a[i:j], packed_b[k:m]
            number = memo.get(key)
            if number is None:
                number = known + len(pending)
                pending.append(key)
                if j - i + m - k <= MOST_WINDOW_BYTES:
                    memo[key] = number
            out.append(number)
        return out

    def documents(self, texts: list[str]) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
        """Per text its counts and the hash of its groups; and (text, id pair, times) of all links, sorted, each pair of a text once."""
        if len(self.text) > MOST_WINDOWS:
            self.forget()
        rows, numbers = [], []
        for text, b in zip(texts, self.b.packed(texts), strict=True):
            a = self.a.packed(" " + text) if text and b is not None else b""
            rows.append([len(a) // 4, len(b) // 4 if a else 0])
            numbers.append(self.windows(a, b) if a else [])
        self.align()
        for row, own in zip(rows, numbers, strict=True):
            at = np.array(own, np.int64)
            digest = hashlib.sha256(";".join(map(self.text.__getitem__, own)).encode()).hexdigest() if own else ""
            row += [int(self.groups[at].sum()), int(self.links[at].sum()), digest]
        starts = self.starts
        window = np.array([n for own in numbers for n in own], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(own) for own in numbers])
        many = starts[window + 1] - starts[window]
        at = np.repeat(starts[window] - np.r_[0, np.cumsum(many)[:-1]] if len(window) else window, many) + np.arange(int(many.sum()))
        key = np.repeat(doc, many) << 40 | self.pairs[at]
        order = np.argsort(key, kind="stable")
        key, times = key[order], self.times[at][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return rows, key[first] >> 40, key[first] & ((1 << 40) - 1), np.add.reduceat(times, first) if len(first) else times


def small_numbers(values: np.ndarray) -> bytes:
    """Numbers that are nearly all below 255, in one byte each; the others follow in four."""
    return len(values).to_bytes(4, "little") + np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u4").tobytes()


def read_small(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", -1, 4 + n)
    return out


def _linked(docs: DataFrame, path_a: str, path_b: str, text: str, keep: tuple[str, ...], chunk_chars: int) -> DataFrame:
    """Rows of documents, whose links are numbers in their chunk's list of id pairs, and one row with that list (and how many of the chunk's documents hold each) per chunk."""
    new = fields(_DOC + ", __chunk long, __pairs binary, __times binary, __ids array<long>, __docs array<int>")
    stay = [c for c in keep if c not in {f.name for f in new}]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType, True) for c in stay), *new])
    arrow = to_arrow_schema(schema)
    source = docs.select(*(F.col(f"`{c}`") for c in stay), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = prepared(lambda: kept(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b)))
        kept(("byte ids", path_a, True), lambda: aligner.a)
        chunk, held, waiting = TaskContext.get().partitionId() << 32, 0, []

        def finished() -> Iterator[pa.RecordBatch]:
            """All waiting slices with one list of pairs."""
            every = np.concatenate([pairs for *_, pairs, _ in waiting])
            ids, docs_with = np.unique(every, return_counts=True)
            for columns, rows, doc, pairs, times in waiting:
                number, bounds = np.searchsorted(ids, pairs), np.searchsorted(doc, np.arange(len(rows) + 1))
                blobs = [(small_numbers(np.diff(number[i:j], prepend=0)), small_numbers(times[i:j])) for i, j in zip(bounds, bounds[1:], strict=False)]
                arrays = [*columns, *map(list, zip(*rows, strict=True)), [chunk] * len(rows), *map(list, zip(*blobs, strict=True)), [None] * len(rows), [None] * len(rows)]
                yield batch_of(arrays)
            yield batch_of([[None]] * (len(arrow) - 5) + [[chunk], [None], [None], pa.array([ids], pa.list_(pa.int64())), pa.array([docs_with.astype(np.int32)], pa.list_(pa.int32()))])

        def batch_of(arrays: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

        for batch in batches:
            texts = batch.column(len(stay)).to_pylist()
            for start, stop in slices(texts, min(SLICE_CHARS, chunk_chars)):
                waiting.append(([batch.column(i).slice(start, stop - start) for i in range(len(stay))], *aligner.documents(texts[start:stop])))
                held += sum(map(len, texts[start:stop]))
                if held >= chunk_chars:
                    yield from finished()
                    chunk, held, waiting = chunk + 1, 0, []
        if waiting:
            yield from finished()

    return source.mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Every document with ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A is a byte-level vocabulary that reads a space and the text, B a piece vocabulary that reads the text and adds the space itself; strings of
    special tokens are plain text. Where tokens of both end, a group ends; a group links each A token in it with each B token. The count of
    an id pair is in how many documents it is linked; ``count_sum`` adds it up over a document's links and ``n_best`` counts the links whose
    pair is the most frequent one of its A id, ties included. Null and empty texts, and those whose tokens don't read a space and the text (where B
    normalizes something), have zeros and an empty hash. Very long texts are whole; repeated rows count each; an empty table gives no rows.
    Of the input only the columns of ``keep`` stay; one with the name of a new column gives way to it.

    Documents are tokenized once and stored with their links as small numbers; a chunk of documents sends each of its id pairs once to be counted
    and gets back its count, so what is shuffled grows with the chunks' vocabularies and not with the links.
    """
    rows = stored(_linked(docs, path_a, path_b, text, keep, chunk_chars), "alignment")
    base = _pieces(path_b)
    listed = rows.where("__ids is not null").select("__chunk", F.posexplode(F.arrays_zip("__ids", "__docs")).alias("__number", "__pair"))
    pairs = listed.select("__chunk", "__number", F.col("__pair.__ids").alias("pair"), F.col("__pair.__docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / base)))  # at most as many rows as B has ids
    counts = counts.select("pair", "n", (F.col("n") == most).alias("best"))
    known = pairs.join(counts, "pair").select(F.col("__chunk").alias("__of"), "__number", "n", "best")
    shown = [c for c in rows.columns if not c.startswith("__")]
    left = rows.where("__ids is null").select(*(f"`{c}`" for c in shown), "__chunk", "__pairs", "__times")
    order = [c for c in shown if c != "groups_sha256"]
    schema = T.StructType([*(left.schema[c] for c in order), *fields("n_best long, count_sum long"), left.schema["groups_sha256"]])
    arrow = to_arrow_schema(schema)

    def counted(documents: pa.Table, numbers: pa.Table) -> pa.Table:
        n, best = np.zeros(numbers.num_rows, np.int64), np.zeros(numbers.num_rows, bool)
        at = numbers.column("__number").to_numpy()
        n[at], best[at] = numbers.column("n").to_numpy(), numbers.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for links, often in zip(documents.column("__pairs").to_pylist(), documents.column("__times").to_pylist(), strict=True):
            own, times = np.cumsum(read_small(links)), read_small(often)
            sums.append(int(n[own] @ times))
            bests.append(int(times[best[own]].sum()))
        columns = {**{c: documents.column(c) for c in shown}, "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.Table.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return left.groupBy("__chunk").cogroup(known.groupBy("__of")).applyInArrow(counted, schema)


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
