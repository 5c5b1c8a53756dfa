"""Ids of byte-level BPE vocabularies, as the tokenizers library gives them, for many texts of a task."""

from __future__ import annotations

import json

import numpy as np

from .common import kept
from .token_counts import PATTERN, byte_symbols

#: Characters below this are letters, digits and marks alike in all Unicode versions, and so to both libraries.
LATIN = "ɐ"


class ByteIds:
    """Encodes whole texts with the faster of two libraries that know the vocabulary; texts beyond Latin and with special tokens go to the tokenizers library.

    ``plain``: strings of special tokens in a text are plain text, otherwise they are those tokens.
    """

    def __init__(self, path: str, plain: bool):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, byte_of = data["model"], {s: b for b, s in enumerate(byte_symbols())}
        special = {a["content"]: a["id"] for a in data["added_tokens"]}
        #: The bytes of each id
        self.raw = {i: bytes(byte_of[c] for c in token) for token, i in model["vocab"].items() if token not in special} | {i: s.encode() for s, i in special.items()}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        ranks = {self.raw[i]: i for token, i in model["vocab"].items() if token not in special}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(set(made)) or data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("needs a byte-level BPE file whose ids ascend with its merges, without normalizer and prefix space")
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = regex.compile("|".join(map(regex.escape, special))) if special and not plain else None

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not _latin(text) or (self.special is not None and self.special.search(text) is not None):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.words.encode_ordinary(text), "<u4").tobytes()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < LATIN
    return True


def byte_ids(path: str, plain: bool) -> ByteIds:
    return kept(("byte ids", path, plain), lambda: ByteIds(path, plain))
