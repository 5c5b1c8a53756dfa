"""Words of many texts at once, as arrays: literal hashes, templates of numbers, names and units, and bounds of texts.

Plain words are cut, lowered, stripped and hashed byte by byte in numpy. Only words with digits or
other than ASCII characters are looked at one by one, and those met before are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

#: What a word can be; EITHER is a capitalised word at the start of a sentence, which may be a name or not
PLAIN, NUMBER, UNIT, NAME, EITHER = range(5)
#: Units of measure (fixed values)
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers kilometre kilometres "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "km/h mph m/s usd eur gbp dollar dollars euro euros cent cents percent % $ € £ °c °f degrees".split()
)
#: Characters read at once, and words kept
PIECE, MOST_WORDS = 1_000_000, 200_000

_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?[%°]?")
_ASCII_EDGE = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))))
_EDGE = _ASCII_EDGE + "“”‘’«»„…–—"
_NOT_UNITS = _EDGE.replace("$", "").replace("%", "")
_ENDS = ".!?:\"”»"
_GAP = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _bytes_of(test) -> np.ndarray:
    return np.array([test(c) for c in range(256)])


_IS_GAP = _bytes_of(lambda c: c == 32 or 9 <= c <= 13)
_IS_CORE = _bytes_of(lambda c: not (c == 32 or 9 <= c <= 13 or chr(c) in _ASCII_EDGE))
_IS_ODD = _bytes_of(lambda c: c >= 128 or 48 <= c <= 57)
_IS_UPPER, _IS_LOWER = _bytes_of(lambda c: 65 <= c <= 90), _bytes_of(lambda c: 97 <= c <= 122)
_IS_END = _bytes_of(lambda c: chr(c) in _ENDS and c < 128)
_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_BYTE_VALUE = np.array([xxhash.xxh64_intdigest(bytes([c])) for c in range(256)], np.uint64)
NUMBER_HASH, NAME_HASH, UNIT_HASH = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<name>", "<unit>"))


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def value(word: str) -> str:
    """The word without its case and the marks at its edges."""
    return word.strip(_EDGE).lower() or word


class Hashes:
    """Hashes of many stretches of an array of bytes: sums of the bytes' values times powers of an odd number, modulo 2**64."""

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.power) <= n:
            steps = [np.full(n + 1, s, np.uint64) for s in (_STEP, pow(_STEP, -1, 1 << 64))]
            for s in steps:
                s[0] = 1
            self.power, self.back = map(np.cumprod, steps)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * self.power[:n], out=total[1:])
        h = (total[end] - total[start]) * self.back[start]
        h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ (h >> np.uint64(29))

    def of(self, texts: list[bytes]) -> np.ndarray:
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        return self(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, ends[:-1]], ends)


@dataclass
class Words:
    """Words of texts end to end; those of text i stand from ``bound[i]`` to ``bound[i + 1]``."""

    literal: np.ndarray
    template: np.ndarray  # the literal of a plain word, one value each for numbers, units and names
    kind: np.ndarray
    bound: np.ndarray

    def left(self) -> np.ndarray:
        """How many words of its text there are from each word on."""
        return np.repeat(self.bound[1:], np.diff(self.bound)) - np.arange(len(self.kind))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[True, _IS_GAP[data], True].astype(np.int8)))
    return edge[0::2], edge[1::2]


def _parts(text: str) -> Iterator[str]:
    """A long text cut at white space."""
    at = 0
    while len(text) - at > PIECE and (gap := _GAP.search(text, at + PIECE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def groups(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts, cut where they are long, in groups of up to PIECE characters, with the number of the text that each part is of."""
    parts: list[str] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for part in _parts(text):
            if parts and size + len(part) > PIECE:
                yield parts, owners
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(i)
            size += len(part)
    if parts:
        yield parts, owners


class Reader:
    """Reads texts. Odd words met before keep their place in arrays, which start anew when full."""

    def __init__(self, most: int = MOST_WORDS):
        self.hashes = Hashes()
        self.units = np.sort(self.hashes.of([u.encode() for u in sorted(UNITS)]))
        self.place: dict[bytes, int] = {}
        self._room(most)

    def _room(self, most: int) -> None:
        self.most = most
        self.literal, self.kind, self.ends = np.zeros(most, np.uint64), np.zeros(most, np.int8), np.zeros(most, bool)

    @staticmethod
    def odd(word: str) -> tuple[str, int]:
        """(value, kind) of a word; NAME for any capitalised one."""
        core = word.strip(_NOT_UNITS) or word
        plain = core.strip(_EDGE).lower() or core
        if _NUMBER.fullmatch(core):
            return plain, NUMBER
        if plain in UNITS or core.lower() in UNITS:
            return plain, UNIT
        bare = core.strip(_EDGE)
        return plain, NAME if bare[:1].isupper() and bare[1:2].islower() else PLAIN

    def _places(self, found: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(found) if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place.clear()
            new = list(dict.fromkeys(found))
            if len(new) > self.most:
                self._room(len(new))
        if new:
            made = [self.odd(w.decode()) for w in new]
            at = slice(len(self.place), len(self.place) + len(new))
            self.literal[at], self.kind[at] = self.hashes.of([v.encode() for v, _ in made]), [k for _, k in made]
            self.ends[at] = [w.decode()[-1] in _ENDS for w in new]
            self.place.update(zip(new, range(at.start, at.stop), strict=True))
        return np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))

    def _read(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(literal, kind, ends, number of words of each part) of some parts."""
        encoded = [p.encode() for p in parts]
        joined = b"\n".join(encoded)
        raw = np.frombuffer(joined, np.uint8)
        begin, end = spans(raw)
        low, low_begin, low_end = _LOWERED[raw], begin, end
        if not joined.isascii():
            low = np.frombuffer("\n".join(parts).lower().encode(), np.uint8)
            low_begin, low_end = spans(low)
        bounds = np.searchsorted(begin, np.cumsum([0, *(len(e) + 1 for e in encoded)]))
        if not len(begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.diff(bounds)
        # strip marks at the edges: the first and the last byte of the core
        core = _IS_CORE[low]
        at, before = np.r_[np.flatnonzero(core), 0], np.r_[0, np.cumsum(core)]
        a, b = before[low_begin], before[low_end]
        bare = a == b
        start, stop = np.where(bare, low_begin, at[a]), np.where(bare, low_end, at[b - 1] + 1)
        literal = self.hashes(low, start, stop)
        first = np.minimum(begin + start - low_begin, len(raw) - 1)
        second = np.minimum(first + 1, len(raw) - 1)
        kind = np.where(_IS_UPPER[raw[first]] & _IS_LOWER[raw[second]] & (first + 1 < end), NAME, PLAIN).astype(np.int8)
        kind[self.units[np.minimum(np.searchsorted(self.units, literal), len(self.units) - 1)] == literal] = UNIT
        ends = _IS_END[raw[end - 1]]
        odd_before = np.r_[0, np.cumsum(_IS_ODD[raw])]
        odd = np.flatnonzero(bare | (odd_before[end] > odd_before[begin]))
        if len(odd):
            place = self._places([joined[x:y] for x, y in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)])
            literal[odd], kind[odd], ends[odd] = self.literal[place], self.kind[place], self.ends[place]
        return literal, kind, ends, np.diff(bounds)

    def __call__(self, texts: list[str]) -> Words:
        made, counts = [], np.zeros(len(texts), np.int64)
        for parts, owners in groups(texts):
            *arrays, many = self._read(parts)
            made.append(arrays)
            np.add.at(counts, owners, many)
        literal, kind, ends = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool))
        bound = np.r_[0, np.cumsum(counts)]
        starts = np.r_[True, ends[:-1]] if len(ends) else ends
        starts[bound[:-1][counts > 0]] = True
        kind[(kind == NAME) & starts] = EITHER
        template = literal.copy()
        for k, h in ((NUMBER, NUMBER_HASH), (UNIT, UNIT_HASH), (NAME, NAME_HASH)):
            template[kind == k] = h
        return Words(literal, template, kind, bound)
