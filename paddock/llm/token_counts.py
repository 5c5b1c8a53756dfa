"""Operator 10, token counts: byte-pair merging with a heap and a linked list, without ids."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from .common import kept, map_texts

#: How the byte-level vocabularies part a text before merging (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Words that a worker remembers at most; longer ones are counted anew each time.
MOST_WORDS, MOST_WORD_CHARS = 700_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs. A symbol is a number; the merge of rank r makes symbol 256 + r."""

    def __init__(self, path: str):
        import regex
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        if model["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("needs a byte-level BPE file without normalizer and prefix space")
        number = {s: b for b, s in enumerate(byte_symbols())}
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(number[left] << 20 | number[right], r)
            number.setdefault(left + right, 256 + r)
        self.result = [0] * len(model["merges"])
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.result[r] = number[left + right]
        special = [a["content"] for a in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.cache: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """How many symbols are left of a word when no pair of neighbours has a rank."""
        rank, result, n = self.rank, self.result, len(word)
        symbol: list[int] = list(word)
        heap = [(r << 32) | i for i in range(n - 1) if (r := rank.get(symbol[i] << 20 | symbol[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n)), n
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << 20 | symbol[j]) != r:
                continue  # the pair is gone
            made = symbol[i] = result[r]
            symbol[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get(made << 20 | symbol[k])) is not None:
                    heappush(heap, (q << 32) | i)
            h = before[i]
            if h >= 0 and (q := rank.get(symbol[h] << 20 | made)) is not None:
                heappush(heap, (q << 32) | h)
        return left

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token and parts what is around it."""
        if not text:
            return 0
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)

    def _split(self, text: str) -> list[str]:
        """Words of a text. Characters outside Latin go by the library's own tables of letters, which may be of another Unicode version."""
        if max(text) < "\u0250":
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _merged(self, text: str) -> int:
        return sum(self.merged(word.encode()) for word in self._split(text))

    def _plain(self, text: str) -> int:
        """A space between two other characters always starts a word, so what lies between such spaces is counted alone, once."""
        first, *rest = text.split(" ")
        cache = self.cache
        if not self._clean(first):
            return self._merged(text)
        total = self._merged(first)
        try:
            return total + sum(map(cache.__getitem__, rest))
        except KeyError:
            pass
        for piece in rest:
            n = cache.get(piece)
            if n is None:
                if not self._clean(piece):
                    return self._merged(text)
                stem = piece[:-1]
                if piece[-1] in ",." and (n := cache.get(stem)) is not None and stem.isalpha():
                    n += 1  # a mark after letters is a word of its own
                else:
                    n = self._merged(" " + piece)
                if len(piece) <= MOST_WORD_CHARS and len(cache) < MOST_WORDS:
                    cache[piece] = n
            total += n
        return total

    @staticmethod
    def _clean(piece: str) -> bool:
        return bool(piece) and not (piece[0].isspace() or piece[-1].isspace() or piece[0] == "\u180e" or piece[-1] == "\u180e")


def merges(path: str) -> Merges:
    return kept(("merges", path), lambda: Merges(path))


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """Every row with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of its whole text.

    Null and empty texts have 0 of both. Nothing is cut or padded, and no special token is added; very long texts are counted whole. Repeated rows are
    counted each, an empty table gives no rows, and of the input only the columns of ``keep`` stay; one with the name of a new column gives way to it.
    """

    def make():
        counter = merges(path)

        def work(texts):
            n = [counter.count(t) for t in texts]
            return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return work

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean", text, keep)
