"""Operator 8, benchmark decontamination: windows of template words, hash-joined, with consistent slots.

Numbers, names and units become typed placeholders, so a benchmark question with other numbers or
names has the same template. A match counts if its placeholders stand for each other consistently, in
both directions. Windows of literal words find verbatim copies however many placeholders they hold.

Most of a corpus has nothing of the benchmark. A bit map of fixed size holds the hashes of the items'
windows and of all pairs of neighbours in them; a window of a document is only built where each of its
pairs is marked, and only leaves the scan if it is marked itself.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import graph, templates
from .common import fields, kept, prepared, slices
from .templates import EITHER, MIX, NAME_HASH, PLAIN, Words

WINDOW = 8
#: Words of an occurrence that must agree or stand for one value again (fewer, in proportion, where it has less than a window)
SURE = 5
#: A document is contaminated if consistent windows cover so many words of an item, or this share of it
COVER_WORDS, COVER_SHARE = 13, 0.5
#: Share of a match's placeholders that must stand for one value each
CONSISTENT = 0.8
#: Where parts of an item stand apart, so many roles of one may stand for other values than in those before it
DIFFER = 2
#: The bit map's size: 2**22 to 2**26 bits (8 MB), by the number of hashes. Beyond that it lets more through, and the join decides as before.
LEAST_BITS, MOST_BITS = 22, 26
PAGE_BITS = 15
#: Rows of one hash are dealt over so many tasks
SALT = 8
_NAME = np.array([NAME_HASH])


def _mixed(columns: Iterable[np.ndarray], size: int) -> np.ndarray:
    mixed = np.array([size], np.uint64)
    for c in columns:
        mixed = (mixed ^ c) * MIX
        mixed = mixed ^ (mixed >> np.uint64(29))
    return mixed


class Marks:
    """A bit map of hashes."""

    def __init__(self, packed: bytes):
        self.bytes = np.frombuffer(packed, np.uint8)
        self.shift = np.uint64(64 - (len(packed) * 8).bit_length() + 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        spot = (hashes >> self.shift).astype(np.int64)
        return (self.bytes[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def _pairs(words: Words, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word and the next are marked as neighbours: by templates, in some reading of them, and by literals."""
    t, either = words.template, words.kind == EITHER
    found = marks(_mixed((t[:-1], t[1:]), 2))
    for first, second in ((True, False), (False, True), (True, True)):
        at = np.flatnonzero(~found & (either[:-1] | (not first)) & (either[1:] | (not second)) & (either[:-1] | either[1:]))
        if len(at):
            a, b = _NAME if first else t[at], _NAME if second else t[at + 1]
            found[at] = marks(np.broadcast_to(_mixed((a, b), 2), len(at)))
    literal = found.copy()
    at = np.flatnonzero((words.kind[:-1] != PLAIN) | (words.kind[1:] != PLAIN))
    literal[at] = marks(_mixed((words.literal[at], words.literal[at + 1]), 2))
    return found, literal


def windows(words: Words, size: int, marks: Marks | None = None, pairs: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, hashes, names, pair hashes) of the windows of ``size`` words.

    ``names`` tells of each word of a window whether it is read as a placeholder. A window comes once for each reading of the capitals
    that start its sentences, and by its literal words if it holds a placeholder or such a capital. A
    window of nothing but placeholders has no template (it would say nothing); its literal words stand for it.
    With ``marks`` only marked windows come.
    """
    n = len(words.kind) - size + 1
    if n < 1:
        return
    inside = words.left()[:n] >= size
    among = lambda flags, width: (c := np.r_[0, np.cumsum(flags)])[width : width + n] - c[:n]
    either = words.kind == EITHER
    sure = (words.kind != PLAIN) & ~either
    filled, opened = among(sure, size), among(either, size)
    by_template, by_literal = inside & (filled < size), inside & (filled + opened > 0)
    if pairs is not None:
        by_template &= among(pairs[0], size - 1) == size - 1
        by_literal &= among(pairs[1], size - 1) == size - 1

    def made(at: np.ndarray, cells: np.ndarray, names: np.ndarray):
        hashes = _mixed(cells.T, size)
        if marks is not None:
            hit = marks(hashes)
            at, hashes, cells, names = at[hit], hashes[hit], cells[hit], names[hit]
        if len(at):
            yield at, hashes, names, np.stack([_mixed((cells[:, j], cells[:, j + 1]), 2) for j in range(size - 1)], axis=1)

    spread = lambda x, at: x[at[:, None] + np.arange(size)]
    at = np.flatnonzero(by_literal)
    if len(at):
        yield from made(at, spread(words.literal, at), np.zeros((len(at), size), bool))
    found = np.flatnonzero(by_template)
    for k in np.unique(opened[found]).tolist():
        at = found[opened[found] == k]
        places = np.argsort(~spread(either, at), axis=1, kind="stable")[:, :k]
        for reading in range(1 << k):
            cells, names = spread(words.template, at), spread(sure, at)
            for j in range(k):
                if reading >> j & 1:
                    cells[np.arange(len(at)), places[:, j]] = NAME_HASH
                    names[np.arange(len(at)), places[:, j]] = True
            some = ~names.all(axis=1)
            yield from made(at[some], cells[some], names[some])


def _role(words: list[str], j: int, kind: int) -> str:
    """What a slot's value stands for: a name for itself, a number or unit for itself before its next word, so that '2 apples' and '2 friends' may change apart."""
    after = templates.value(words[j + 1]) if kind in (templates.NUMBER, templates.UNIT) and j + 1 < len(words) else ""
    return f"{templates.value(words[j])}\0{after}"


WINDOW_DDL = "copy long, hash long, start int, size int, n_words int, roles array<string>, pairs array<long>"


def _windows_of(batches: Iterator[pa.RecordBatch], sizes: list[int] | None, packed: bytes | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The windows of each text; with a bit map those that are marked, without ``sizes`` those of one size (all words of a short text).

    ``copy`` is a hash of the text: it tells texts of one id apart. ``roles`` holds a text for each word, empty where it isn't a placeholder.
    """
    marks = None if packed is None else Marks(packed)
    read = prepared(lambda: kept("templates", templates.Reader))
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in slices(texts, 2_000_000):
            found = read(texts[a:b])
            counts = np.diff(found.bound)
            pairs = None if marks is None or len(found.kind) < 2 else _pairs(found, marks)
            rows: dict[str, list] = {n: [] for n in ("text", *schema.names[1:])}
            told: dict[int, tuple[int, list[str]]] = {}
            for size in sizes or range(3, WINDOW + 1):
                for starts, hashes, names, near in windows(found, size, marks, pairs):
                    owner = np.searchsorted(found.bound, starts, "right") - 1
                    if sizes is None:  # windows of the text's own size only
                        own = np.minimum(WINDOW, counts[owner]) == size
                        starts, hashes, names, near, owner = (x[own] for x in (starts, hashes, names, near, owner))
                    for i, s, h, named, p in zip(owner.tolist(), starts.tolist(), hashes.view(np.int64).tolist(), names.tolist(), near.view(np.int64), strict=True):
                        if i not in told:
                            told[i] = xxhash.xxh64_intdigest(texts[a + i], 42), templates.words(texts[a + i])
                        copy, words = told[i]
                        first = s - int(found.bound[i])
                        roles = [_role(words, first + j, found.kind[s + j]) if y else "" for j, y in enumerate(named)]
                        for name, v in zip(rows, (a + i, copy - (1 << 64) if copy >> 63 else copy, h, first, size, len(words), roles, p if marks is None else None), strict=True):
                            rows[name].append(v)
            if rows["text"]:
                values = [ids.take(pa.array(rows["text"])).cast(schema.field(0).type), *(pa.array(rows[f.name], f.type) for f in list(schema)[1:])]
                yield pa.RecordBatch.from_arrays(values, schema=schema)


def _emit(rows: DataFrame, key: str, text: str, sizes: list[int] | None = None, marks=None) -> DataFrame:
    """(id, copy, hash, start, size, n_words, roles, pairs) of windows; ``marks`` is a broadcast bit map."""
    source = rows.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *fields(WINDOW_DDL)])
    arrow = to_arrow_schema(schema)
    return source.mapInArrow(lambda batches: _windows_of(batches, sizes, marks.value if marks else None, arrow), schema)


def _marks(item_windows: DataFrame) -> bytes:
    """The bit map of the items' windows and pairs, made page by page on the executors."""
    hashes = item_windows.select("hash").union(item_windows.select(F.explode("pairs"))).distinct()
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * n).bit_length()))
    top = F.shiftrightunsigned("hash", 64 - bits)
    dealt = hashes.select(F.shiftright(top, PAGE_BITS).alias("page"), top.bitwiseAND((1 << PAGE_BITS) - 1).cast("int").alias("bit"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                page = np.zeros(1 << PAGE_BITS, bool)
                page[found] = True
                out.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page", "bits"])

    pages = dealt.groupBy("page").agg(F.collect_set("bit").alias("bits")).mapInArrow(packed, "page long, bits binary").collect()
    whole, size = bytearray(1 << bits >> 3), 1 << PAGE_BITS >> 3
    for r in pages:
        whole[r["page"] * size : (r["page"] + 1) * size] = r["bits"]
    return bytes(whole)


def _share(pairs: Iterable[tuple[str, str]]) -> float:
    """Share of the pairs whose second is the commonest partner of their first."""
    partners = Counter(pairs)
    best: dict[str, int] = {}
    for (x, _), n in partners.items():
        best[x] = max(best.get(x, 0), n)
    return sum(best.values()) / sum(partners.values()) if partners else 1.0


def _bare(role: str) -> str:
    return role.partition("\0")[0]


def _steady(pairs: dict[int, tuple[str, str]]) -> float:
    """Share of the slots that stand for each other, in the worse direction: of an item's role for one value, and of a document's for one of the item's."""
    found = pairs.values()
    return min(_share((x, _bare(y)) for x, y in found), _share((y, _bare(x)) for x, y in found))


def _values(pairs: Iterable[tuple[str, str]], common: tuple[Counter, Counter]) -> tuple[dict[str, str], dict[str, str]]:
    """What each of the item's roles stands for most often, and each of the document's; of values as frequent the one that is more ``common``."""
    found = list(pairs)
    there, back = Counter((x, _bare(y)) for x, y in found), Counter((y, _bare(x)) for x, y in found)
    order = lambda told, all_: dict(sorted(told, key=lambda k: (told[k], all_[k], k)))
    return order(there, common[0]), order(back, common[1])


class Occurrence:
    """Where a document holds words of an item: the item's positions, the pairs of roles at its slots and the positions that agree literally."""

    def __init__(self):
        self.windows: set[int] = set()
        self.covered: set[int] = set()
        self.same: set[int] = set()
        self.pairs: dict[int, tuple[str, str]] = {}

    def add(self, at: int, theirs: list[str], roles: list[str]) -> None:
        """A window at the item's position ``at``: the document's roles and the item's."""
        self.windows.add(at)
        for p, (y, x) in enumerate(zip(theirs, roles, strict=True), at):
            self.covered.add(p)
            if x and y:
                self.pairs[p] = x, y
            if not x or not y or _bare(x) == _bare(y):
                self.same.add(p)  # by a literal window or a plain word, or with the item's value

    def join(self, other: Occurrence) -> None:
        """Takes in ``other``; where both hold a position this one's value stays."""
        self.same |= other.same - self.covered
        self.windows |= other.windows
        self.covered |= other.covered
        self.pairs = other.pairs | self.pairs

    def share(self) -> float:
        return _steady(self.pairs)

    def share_with(self, other: Occurrence) -> float:
        return _steady(other.pairs | self.pairs)

    def enough(self, item_words: int) -> bool:
        return len(self.covered) >= min(COVER_WORDS, COVER_SHARE * item_words)

    def proven(self) -> bool:
        """Whether enough words tell of the item: those that agree, and slots whose role comes again and stands for one value."""
        partners: dict[str, list[str]] = {}
        for x, y in self.pairs.values():
            partners.setdefault(x, []).append(_bare(y))
        steady = {x for x, ys in partners.items() if len(ys) > 1 and len(set(ys)) == 1}
        sure = self.same | {p for p, (x, _) in self.pairs.items() if x in steady}
        return len(sure) >= min(SURE, (SURE * len(self.covered) + WINDOW // 2) // WINDOW)

    def passes(self, item_words: int) -> bool:
        return self.enough(item_words) and self.share() >= CONSISTENT and self.proven()

    def key(self) -> tuple:
        return tuple(sorted(self.covered)), tuple(sorted(self.pairs.items())), tuple(sorted(self.same))


class Pieces:
    """Parts of an item that stand apart in a text, none of which suffices.

    Parts may be taken together if the slots of both stand for each other in the share that an occurrence needs, and at most ``DIFFER`` of the
    roles that both hold stand for different values. A part is looked up by the positions that it covers and by its values of
    those roles, the fewest differences first; what has been looked up once is kept. So parts that can't agree never
    meet, and n parts take time in proportion to n and to the places of the item, not to their pairs.
    """

    def __init__(self, found: list[Occurrence]):
        self.all = sorted(found, key=lambda o: (-len(o.covered), o.key()))
        pairs = [pair for o in self.all for pair in o.pairs.values()]
        self.common = Counter((x, _bare(y)) for x, y in pairs), Counter((y, _bare(x)) for x, y in pairs)
        self.values = [_values(o.pairs.values(), self.common) for o in self.all]
        self.shapes: dict[tuple, list[int]] = {}
        for i, o in enumerate(self.all):
            self.shapes.setdefault((frozenset(o.covered), frozenset((p, x) for p, (x, _) in o.pairs.items())), []).append(i)
        self.views: dict[tuple, tuple] = {}
        self.by_value: dict[tuple, dict[tuple, list[int]]] = {}
        self.first: dict[tuple, int | None] = {}

    def _view(self, shape: tuple, fresh: frozenset) -> tuple[set[str], set[str], dict[int, tuple]]:
        """The roles and values that parts of a shape have at the positions ``fresh``, and those of each part."""
        if (shape, fresh) not in self.views:
            each = {i: _values((pair for p, pair in self.all[i].pairs.items() if p in fresh), self.common) for i in self.shapes[shape]}
            self.views[shape, fresh] = {x for p, x in shape[1] if p in fresh}, {y for _, back in each.values() for y in back}, each
        return self.views[shape, fresh]

    def _lookup(self, shape: tuple, fresh: frozenset, known: tuple, told: tuple, taken: frozenset) -> int | None:
        """The first part of a shape with these values of these roles, whose values stand for what ``taken`` says."""
        asked = shape, fresh, known, told, taken
        if asked not in self.first:
            each = self._view(shape, fresh)[2]
            index = self.by_value.get((shape, fresh, known))
            if index is None:
                index = self.by_value[shape, fresh, known] = {}
                for i, (there, _) in each.items():
                    index.setdefault(tuple(there[x] for x in known), []).append(i)
            bound = dict(taken)
            agrees = lambda i: all(bound.get(y, x) == x for y, x in each[i][1].items())
            self.first[asked] = next((i for i in index.get(told, ()) if agrees(i)), None)
        return self.first[asked]

    def _partner(self, seed: Occurrence, shape: tuple, there: dict[str, str], back: dict[str, str]) -> int | None:
        """A part of a shape that may be taken together with ``seed``, whose values these are; where both hold a position the seed's value stays."""
        fresh = frozenset(p for p, _ in shape[1] if p not in seed.covered)
        roles, values, _ = self._view(shape, fresh)
        ours, theirs = sorted(roles & there.keys()), sorted(values & back.keys())
        most = min(DIFFER, int((1 - CONSISTENT) * (len(seed.pairs) + len(fresh)) + 1e-9))
        bonds = [*((x, None) for x in ours), *((None, y) for y in theirs)]
        for n in range(most + 1):
            for loose in itertools.combinations(bonds, n):
                known = tuple(x for x in ours if (x, None) not in loose)
                taken = frozenset((y, back[y]) for y in theirs if (None, y) not in loose)
                j = self._lookup(shape, fresh, known, tuple(there[x] for x in known), taken)
                if j is not None and seed.share_with(self.all[j]) >= CONSISTENT:
                    return j
        return None

    def whole(self, item_words: int) -> Occurrence | None:
        """The first part that passes together with those that agree with it, the largest first."""
        held = Counter(y for there, _ in self.values for y in set(there.values()))
        tried = set()
        for i, o in enumerate(self.all):
            # values that no other part holds make no difference but by where they come again
            names: dict[str, int] = {}
            for _, (_, y) in sorted(o.pairs.items()):
                names.setdefault(y, len(names))
            sign = tuple(sorted(o.covered)), tuple(sorted(o.same)), tuple((p, x, y if held[_bare(y)] > 1 else names[y]) for p, (x, y) in sorted(o.pairs.items()))
            if sign in tried:
                continue
            tried.add(sign)
            seed, (there, back) = Occurrence(), self.values[i]
            seed.join(o)
            for shape in self.shapes:
                if not shape[0] <= seed.covered and (j := self._partner(seed, shape, there, back)) is not None:
                    seed.join(self.all[j])
                    there, back = _values(seed.pairs.values(), self.common)
            if seed.passes(item_words):
                return seed
        return None


class Verdict:
    """Takes in the hits of one item in one text, sorted by alignment (document start minus item start).

    Hits of one alignment are one occurrence, so values of different copies never mix. Where no
    occurrence suffices (words inserted, sentences apart), those that agree with each other are taken together. What
    it holds of an occurrence that has passed are three numbers; of the others it keeps one of each kind.
    """

    def __init__(self, item_words: int):
        self.item_words, self.alignment = item_words, None
        self.open, self.best = Occurrence(), None
        self.parts: dict[tuple, Occurrence] = {}
        self.covered: set[int] = set()

    def add(self, start: int, at: int, theirs: list[str], roles: list[str]) -> None:
        if start - at != self.alignment:
            self._close()
            self.alignment = start - at
        self.open.add(at, theirs, roles)

    def _close(self) -> None:
        done, self.open = self.open, Occurrence()
        if not done.covered:
            return
        if done.passes(self.item_words):
            told = len(done.windows), len(done.covered), done.share()
            self.best = max(self.best or told, told)
            self.parts.clear()
        elif self.best is None:
            self.parts.setdefault(done.key(), done)
            self.covered |= done.covered

    def result(self) -> tuple[int, int, float] | None:
        """(windows, covered words, slot share) of the best occurrence that makes a document contaminated, None if none does."""
        self._close()
        if self.best is None and len(self.parts) > 1 and len(self.covered) >= min(COVER_WORDS, COVER_SHARE * self.item_words):
            whole = Pieces(list(self.parts.values())).whole(self.item_words)
            if whole is not None:
                self.best = len(whole.windows), len(whole.covered), whole.share()
        return self.best


def verdict(hits: list[dict], item_words: int) -> tuple[int, int, float] | None:
    """The verdict of hits in any order."""
    made = Verdict(item_words)
    for h in sorted(hits, key=lambda h: (h["start"] - h["at"], h["at"], h["theirs"], h["roles"])):
        made.add(h["start"], h["at"], h["theirs"], h["roles"])
    return made.result()


#: What tells one item in one text from another
_PAIR = ["doc", "copy", "item", "item_copy", "item_words"]


def _judged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The verdicts of hits sorted by text, item and alignment, read as a stream: a text's hits are never together in one row."""
    key, made, rows = None, None, []

    def told() -> None:
        if made is not None and (m := made.result()) is not None:
            rows.append((*key[:3], key[4], *m))

    def batch_of(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_PAIR, "start", "at", "theirs", "roles")]
        for *own, start, at, theirs, roles in zip(*columns, strict=True):
            if own != key:
                told()
                key, made = own, Verdict(own[4])
            made.add(start, at, theirs, roles)
        if rows:
            yield batch_of(rows)
            rows = []
    told()
    if rows:
        yield batch_of(rows)


def found(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, copy, item, item_words, n_windows, covered_words, slot_share): a row for each item that a document's text holds; ``copy`` is Spark's xxhash64 of the text.

    Only marked windows leave the scan of the documents; they meet the items' windows in a hash join,
    dealt by hash and salt so that a window which many documents share is spread. The ids keep their types. Null texts, texts shorter
    than an item and empty tables match nothing; an item of fewer than 8 words has one window of all
    its words (of 3 at least). Extra columns are left aside.
    """
    items = graph.saved(_emit(benchmark.where(F.col(f"`{item_id}`").isNotNull()), item_id, text), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    marks = docs.sparkSession.sparkContext.broadcast(_marks(items))
    hits = _emit(docs, doc_id, text, sizes or [WINDOW], marks).withColumn("salt", F.pmod(F.xxhash64("copy", "start"), F.lit(SALT)).cast("int"))
    theirs = items.select(
        "hash", "size", F.col("id").alias("item"), F.col("copy").alias("item_copy"), F.col("n_words").alias("item_words"), F.col("start").alias("at"), F.col("roles").alias("item_roles"),
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"),
    )
    joined = hits.join(theirs, ["hash", "size", "salt"]).select(F.col("id").alias("doc"), "copy", "item", "item_copy", "item_words", "start", "at", F.col("roles").alias("theirs"), F.col("item_roles").alias("roles"))
    # the hits of a text and item come together, one alignment after the other
    held = joined.repartition(*_PAIR).sortWithinPartitions(*_PAIR, F.col("start") - F.col("at"), "at", "theirs", "roles")
    schema = T.StructType([*(held.schema[c] for c in ("doc", "copy", "item", "item_words")), *fields("n_windows long, covered_words long, slot_share double")])
    arrow = to_arrow_schema(schema)
    made = held.mapInArrow(lambda batches: _judged(batches, arrow), schema)
    best = made.groupBy("doc", "copy", "item").agg(F.max(F.struct("covered_words", "slot_share", "n_windows", "item_words")).alias("m"))
    return best.select("doc", "copy", "item", "m.item_words", "m.n_windows", "m.covered_words", "m.slot_share")


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, covered_words, item_words, slot_share) of the contaminated documents, a row for each item they hold. Rows without an id are left out."""
    best = found(docs, benchmark, doc_id, item_id, text).where("doc is not null").groupBy("doc", "item").agg(F.max(F.struct("covered_words", "slot_share", "n_windows", "item_words")).alias("m"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "m.n_windows", "m.covered_words", F.col("m.item_words").cast("long").alias("item_words"), "m.slot_share")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, also those without an id. Of texts under one id only the contaminated go."""
    bad = found(docs, benchmark, doc_id, text=text).select(F.col("doc").alias("__doc"), F.col("copy").alias("__copy")).distinct()
    id_, own = F.col(f"`{doc_id}`"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.join(bad, id_.eqNullSafe(F.col("__doc")) & (own == F.col("__copy")), "left_anti")
