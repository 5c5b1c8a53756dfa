"""Operator 7, SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts, prepared

SPACE = "▁"
#: Units that a worker remembers at most.
MOST_UNITS = 250_000
#: Longer units are encoded anew each time.
MOST_UNIT_CHARS = 64
DECODE_ROWS = 256
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


class Vocabulary:
    """Pieces, scores and byte pieces of a model, read with the library's own accessors.

    ``pair`` gives for two neighbouring symbols the order of their merge (0: the best score; equal
    scores share it), shifted by 20 bits, and the symbol it makes. Symbols are piece ids, and further numbers for
    characters that are no piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.vocab_size()
        piece_id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(self.size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                value = int(_BYTE.match(piece)[1], 16)
                self.byte_id[value] = i
                self.raw.append(bytes([value]))
            elif self.library.is_control(i):
                self.raw.append(b"")
            elif self.library.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                piece_id[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_id) != 256 or any(SPACE in p.lstrip(SPACE) for p in piece_id):
            raise ValueError("needs byte fallback, and spaces only at the start of pieces")
        self.symbol = {c: piece_id.get(c, self.size + k) for k, c in enumerate(dict.fromkeys("".join(piece_id)))}
        self.other = self.size + len(self.symbol)  # a character of no piece
        known = piece_id | self.symbol
        orders = {s: k for k, s in enumerate(sorted({self.library.get_score(i) for i in piece_id.values()}, reverse=True))}
        self.pair: dict[int, int] = {}
        for piece, i in piece_id.items():
            for cut in range(1, len(piece)):
                left, right = known.get(piece[:cut]), known.get(piece[cut:])
                if left is not None and right is not None:
                    self.pair[left << 20 | right] = orders[self.library.get_score(i)] << 20 | i
        self.keys = np.array(sorted(self.pair), np.int64)
        self.values = np.array([self.pair[k] for k in self.keys.tolist()], np.int64)
        #: Piece of each character of the Basic Multilingual Plane, -1 for none; the last entry stands for all others
        self.by_code = np.full(0x10001, -1, np.int64)
        for c, i in self.symbol.items():
            if i < self.size and ord(c) < 0x10000:
                self.by_code[ord(c)] = i
        self.plain = re.compile("[" + "".join(re.escape(c) for c, i in self.symbol.items() if i < self.size and ord(c) < 0x10000) + "]+")


_MADE, _NONE = (1 << 20) - 1, 1 << 60
#: Units up to this length are encoded together, each with its own agenda in one row of an array.
SHORT, TOGETHER = 24, 8192


def encode_together(units: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """agenda_encode for many short units of known characters: each step pops the best pair of every unit's agenda."""
    keys, values, m = vocabulary.keys, vocabulary.values, len(units)
    width = max(map(len, units)) + 1
    code = np.zeros((m, width), np.uint32)
    flat = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le"), np.uint32)
    code[:] = flat.reshape(m, width)
    lengths = np.fromiter(map(len, units), np.int64, m)
    position = np.arange(width)
    symbol = np.where(position < lengths[:, None], vocabulary.by_code[np.minimum(code, len(vocabulary.by_code) - 1)], -1).astype(np.int64)

    def look(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], _NONE)

    agenda = np.full((m, width), _NONE)
    agenda[:, :-1] = look(symbol[:, :-1], symbol[:, 1:])
    after, before = np.tile(np.minimum(position + 1, width - 1), (m, 1)), np.tile(position - 1, (m, 1))
    rows = np.arange(m)
    while len(rows):
        i = (agenda[rows] >> 20).argmin(axis=1)  # of equal orders the leftmost
        best = agenda[rows, i]
        live = best < _NONE
        rows, i, best = rows[live], i[live], best[live]
        j = after[rows, i]
        k = after[rows, j]
        h = before[rows, i]
        made = best & _MADE
        symbol[rows, i], symbol[rows, j] = made, -1
        agenda[rows, j] = _NONE
        after[rows, i], before[rows, k] = k, i
        agenda[rows, i] = np.where(k > j, look(made, symbol[rows, k]), _NONE)
        at = np.flatnonzero(h >= 0)
        agenda[rows[at], h[at]] = look(symbol[rows[at], h[at]], made[at])
    left = symbol >= 0
    ids, ends = symbol[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def agenda_encode(unit: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of one unit. The agenda holds neighbours that form a piece, the best score first, then the leftmost."""
    pair, n, other = vocabulary.pair, len(unit), vocabulary.other
    symbol = [vocabulary.symbol.get(c, other) for c in unit]
    agenda = [(found >> 20 << 32) | i for i in range(n - 1) if (found := pair.get(symbol[i] << 20 | symbol[i + 1])) is not None]
    heapify(agenda)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while agenda:
        top = heappop(agenda)
        i = top & 0xFFFFFFFF
        j = after[i]
        if symbol[i] < 0 or j >= n or (found := pair.get(symbol[i] << 20 | symbol[j])) is None or found >> 20 != top >> 32:
            continue  # one of the two has been merged meanwhile
        made = symbol[i] = found & _MADE
        symbol[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := pair.get(made << 20 | symbol[k])) is not None:
                heappush(agenda, (found >> 20 << 32) | i)
        h = before[i]
        if h >= 0 and (found := pair.get(symbol[h] << 20 | made)) is not None:
            heappush(agenda, (found >> 20 << 32) | h)
    ids: list[int] = []
    for i, s in enumerate(symbol):
        if 0 <= s < vocabulary.size:
            ids.append(s)
        elif s >= 0:
            ids.extend(map(vocabulary.byte_id.__getitem__, unit[i].encode()))
    return ids


#: A unit is a run of spaces with the characters up to the next space: no piece has a space after another character.
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Codec:
    """Encodes and decodes texts of a task; units met before come from a bounded cache.

    The new units of each batch are checked against the library in one call; a difference raises.
    """

    def __init__(self, path: str, check: bool = True):
        self.vocabulary = Vocabulary(path)
        self.check = check
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def units(self, text: str) -> list[str]:
        """Units of a text as the model normalizes it; merges never cross from one into the next."""
        normal = self.vocabulary.library.normalize(text) if text else ""
        return _UNIT.findall(normal) if SPACE * 2 in normal or normal[:1] != SPACE or normal[-1:] == SPACE else self._words(normal)

    @staticmethod
    def _words(normal: str) -> list[str]:
        return normal.replace(SPACE, " " + SPACE)[1:].split(" ")

    def _verify(self, made: list[tuple[str, list[int]]]) -> None:
        # the library puts one space before what it gets: leave it out where the unit has its own
        own = [(u[1:].replace(SPACE, " "), ids) for u, ids in made if u[0] == SPACE and len(u) > 1]
        for (text, ids), expected in zip(own, self.vocabulary.library.encode([t for t, _ in own], num_threads=1), strict=True):
            if ids != expected:
                raise ValueError(f"encoding of {text[:80]!r} differs from the library's: {ids[:20]} and {expected[:20]}")

    def entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.vocabulary.raw.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text its units' (number of ids, ids with commas, decoded bytes)."""
        cache, split = self.cache, [self.units(t) for t in texts]
        new = dict.fromkeys(u for units in split for u in units if u not in cache)
        together = [u for u in new if len(u) <= SHORT and self.vocabulary.plain.fullmatch(u)]
        made = [x for a in range(0, len(together), TOGETHER) for x in zip(together[a : a + TOGETHER], encode_together(together[a : a + TOGETHER], self.vocabulary), strict=True)]
        done = set(together)
        made += [(u, agenda_encode(u, self.vocabulary)) for u in new if u not in done]
        if self.check:
            self._verify(made)
        fresh = {u: self.entry(ids) for u, ids in made}
        out = [[cache.get(u) or fresh[u] for u in units] for units in split]
        for u, e in fresh.items():
            if len(cache) >= MOST_UNITS:
                break
            if len(u) <= MOST_UNIT_CHARS:
                cache[u] = e
        return out


def decoded(parts: list[bytes]) -> str:
    """Text of decoded pieces, without the space that encoding puts in front."""
    raw = b"".join(parts)
    return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


def codec(path: str, check: bool = True) -> Codec:
    return kept(("sentencepiece", path, check), lambda: Codec(path, check))


def _ids(parts: list[list[tuple[int, str, bytes]]]) -> pa.Array:
    """One list of ids for each text."""
    lengths = [sum(p[0] for p in units) for units in parts]
    each = [np.fromstring(",".join([p[1] for p in units]), np.int32, sep=",") for units in parts if units]
    values = np.concatenate(each) if each else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), check: bool = True) -> DataFrame:
    """Every row with ``ids`` (array of int): what the library's encode gives, without begin or end ids. Null and empty: none."""

    def make():
        coder = codec(path, check)
        return lambda texts: [_ids(coder.encode(texts))]

    return map_texts(docs, make, "ids array<int>", text, keep)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), check: bool = True) -> DataFrame:
    """Every row with ``ids``, their number ``n_tokens``, and ``decoded``, the text that they decode to."""

    def make():
        coder = codec(path, check)

        def work(texts):
            parts = coder.encode(texts)
            return [_ids(parts), [sum(p[0] for p in units) for units in parts], [decoded([p[2] for p in units]) for units in parts]]

        return work

    return map_texts(docs, make, "ids array<int>, n_tokens long, decoded string", text, keep)


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with ``text`` decoded from its ids; null and empty: empty text."""
    stay = [c for c in keep if c != "text"]
    source = rows.select(*stay, F.coalesce(ids, F.array().cast("array<int>")).alias("__ids"))

    def run(batches):
        raw = prepared(lambda: codec(path)).vocabulary.raw
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(start, DECODE_ROWS)
                texts = [decoded([raw[x] for x in row.as_py()]) for row in part.column(len(stay))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(stay)], pa.array(texts, pa.string())], names=[*stay, "text"])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(stay)]), "text string"]))


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), check: bool = True) -> DataFrame:
    """Every row with ``n_tokens``, and SHA-256 of its ids joined by commas and of the text decoded from them.

    Null and empty texts have no ids. Very long texts and words are whole; repeated rows are
    encoded alike; an empty table gives no rows. Of the input only the columns of ``keep`` stay; one with the name of a new column gives way to it.
    """

    def make():
        coder = codec(path, check)

        def work(texts):
            n, ids_sha, text_sha = [], [], []
            for parts in coder.encode(texts):
                n.append(sum(p[0] for p in parts))
                ids_sha.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded([p[2] for p in parts]).encode()).hexdigest())
            return [n, ids_sha, text_sha]

        return work

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", text, keep)
