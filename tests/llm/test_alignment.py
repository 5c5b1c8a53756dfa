"""Alignment against plain loops over the libraries' tokens, for given documents and for odd and random texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_packing import library
from test_tokenizers import texts

from paddock.llm import alignment
from paddock.llm.common import table
from paddock.llm.token_counts import byte_symbols

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _tokens(text: str, lib, pieces, number) -> tuple[list, list] | None:
    """(id, start, end) of both sides' tokens, if they read a space and the text."""
    if not text:
        return None
    ids = lib.encode(" " + text, add_special_tokens=False).ids
    raw_a = [text_of.encode() if (text_of := lib.id_to_token(i)) == "<|endoftext|>" else bytes(number[c] for c in lib.id_to_token(i)) for i in ids]
    ids_b = pieces.encode(text)
    raw_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [pieces.id_to_piece(i)]]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None
    sides = []
    for given, raw in ((ids, raw_a), (ids_b, raw_b)):
        ends = np.cumsum([len(r) for r in raw]).tolist()
        sides.append(list(zip(given, ends, strict=True)))
    return tuple(sides)


def _expected(rows: list[tuple]) -> list[tuple]:
    lib, pieces = library(plain=True), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    number, docs, linked = {s: b for b, s in enumerate(byte_symbols())}, [], Counter()
    for key, text in rows:
        sides = _tokens(text, lib, pieces, number)
        groups = []
        if sides:
            ends = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
            parts = [defaultdict(list) for _ in sides]
            for part, side in zip(parts, sides, strict=True):
                for i, end in side:
                    part[next(e for e in ends if e >= end) if len(ends) < 50 else ends[np.searchsorted(ends, end)]].append(i)
            groups = [(parts[0][e], parts[1][e]) for e in ends]
        links = [(x, y) for a, b in groups for x in a for y in b]
        linked.update(set(links))
        docs.append((key, sides, groups, links))
    best = defaultdict(int)
    for (x, _), n in linked.items():
        best[x] = max(best[x], n)
    out = []
    for key, sides, groups, links in docs:
        shown = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""
        out.append((key, *(map(len, sides) if sides else (0, 0)), len(groups), len(links), sum(linked[p] == best[p[0]] for p in links), sum(linked[p] for p in links), shown))
    return sorted(out, key=str)


def _found(df) -> list[tuple]:
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


GIVEN = [(i, t) for i, t in enumerate([*texts()[:900:3], "one two three", "one two three", None, "", "a  b", " lead", "trail ", "tab\there", "▁ x", "<|endoftext|> x <s>", "é" * 500, "0" * 400])]


@pytest.mark.parametrize("chunk_chars", [300, alignment.CHUNK_CHARS])
def test_odd_and_random_texts_equal_plain_loops(spark, chunk_chars):
    given = [*GIVEN, (None, "no id"), (None, "no id"), (3, "again")]
    docs = spark.createDataFrame([(t, i, 1) for i, t in given], "text string, doc_id long, n_a int").repartition(3)
    assert _found(alignment.align(docs, BYTES, PIECES, chunk_chars=chunk_chars)) == _expected(given)


def test_bounds_of_what_is_remembered_change_nothing(monkeypatch):
    given = [t or "" for _, t in GIVEN]

    def all_of(aligner):
        out = []
        for at in [*range(0, len(given), 10), *range(0, len(given), 10)]:
            rows, doc, pairs, times = aligner.documents(given[at : at + 10])
            out.append((rows, Counter({(d, p): t for d, p, t in zip(doc.tolist(), pairs.tolist(), times.tolist(), strict=True)})))
        return out

    usual = all_of(alignment.Aligner(BYTES, PIECES))
    for name, value in {"LARGE_GROUP": 2, "MOST_WINDOWS": 20, "MOST_WINDOW_BYTES": 40, "MOST_WORDS": 10, "MOST_WORD_CHARS": 3}.items():
        monkeypatch.setattr(alignment, name, value)
    assert all_of(alignment.Aligner(BYTES, PIECES)) == usual


def test_query_equals_plain_loops(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert _found(alignment.align(docs, BYTES, PIECES)) == _expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_tables_and_small_numbers(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0
    for values in ([], [0, 254, 255, 256, 70_000, 1]):
        assert alignment.read_small(alignment.small_numbers(np.array(values, np.int64))).tolist() == values
