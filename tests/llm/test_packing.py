"""Packing: what is packed against the tokenizer library, how densely against the least number of sequences, and best fit against a plain loop."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paddock.llm import packing
from paddock.llm.byte_ids import ByteIds
from paddock.llm.common import table

from test_tokenizers import texts

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(plain: bool = False) -> Tokenizer:
    found = Tokenizer.from_file(BYTES)
    found.encode_special_tokens = plain
    return found


def test_ids_equal_the_library():
    for plain in (False, True):
        coder, lib = ByteIds(BYTES, plain), library(plain)
        for t in texts() * 2:  # the second time from the cache
            ids = np.frombuffer(coder.packed(t), "<u4").tolist()
            assert ids == lib.encode(t, add_special_tokens=False).ids, repr(t)
            assert b"".join(coder.raw[i] for i in ids).decode() == t


def _plain_best_fit(lengths, capacity):
    free, where = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(f, b) for b, f in enumerate(free) if f >= n]
        if fits:
            b = min(fits)[1]
            free[b] -= n
        else:
            free.append(capacity - n)
        where.append(n)
    return sorted(capacity - f for f in free)


def test_best_fit_equals_a_plain_loop():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([1, 7, 64])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 60))], np.int64)
        bins, offsets, fills = packing.best_fit(lengths, capacity)
        assert sorted(fills.tolist()) == _plain_best_fit(lengths.tolist(), capacity)
        held = defaultdict(list)
        for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
            held[b].append((o, n))
        for b, parts in held.items():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at == fills[b] <= capacity


def _check(rows, given, capacity):
    """Pieces are the library's ids cut as agreed, and sequences have no gaps; returns the number of sequences and the least one."""
    lib, by_doc, by_sequence, total = library(), defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(given)
    for key, text in given.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [packing.END]
        parts, at = sorted(by_doc[key], key=lambda r: r.piece), 0
        assert [p.piece for p in parts] == list(range(-(-len(ids) // capacity)))
        for p in parts:
            own = ids[at : at + p.length]
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and (p.piece == 0 or p.length == capacity)
            assert "ids" not in p.__fields__ or p.ids == own
            at += p.length
        assert at == len(ids)
        total += len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_documents_are_packed_densely(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(12)
    rows = packing.pack(docs, BYTES).collect()
    given = {r.doc_id: r.text for r in docs.collect()}
    made, least = _check(rows, given, packing.CAPACITY)
    assert made <= least * 1.01 + 1


def test_small_windows_rounds_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUND_BINS", 40)
    rows = texts()[:400] + [None, "", "x " * 5000, "<|endoftext|>" * 40]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(rows)], "doc_id long, text string, offset string").repartition(9)
    found = packing.pack(docs, BYTES, capacity=32, ids=True, keep=("doc_id", "offset"), window=20)
    made, least = _check(found.collect(), dict(enumerate(rows)), 32)
    assert made <= least * 1.1 + 1
    whole = packing.sequences(found).collect()
    assert len(whole) == made and all(len(r.ids) == r.length <= 32 for r in whole)


def test_items_that_dont_fit_together_end_the_rounds(spark):
    docs = spark.createDataFrame([(i, "a" * 1) for i in range(500)], "doc_id long, text string").repartition(16)
    found = packing.pack(docs, BYTES, capacity=3)  # two tokens each: no two in one sequence
    assert found.select("sequence_id").distinct().count() == 500


def test_empty_null_ids_and_repeated_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, None)], "doc_id long, text string")
    rows = packing.pack(docs, BYTES).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
