"""Encoding and counting against the libraries on odd and random texts."""

import hashlib
import random

import public_tokenizers
import pytest

from paddock.llm import sentencepiece_bpe, token_counts

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a  ", "\n\n x\t y  z ", "a<|endoftext|>b  <|endoftext|>", "'s don't I'LL we've", "١٢٣ ½ ² ㊿ x", "​  a　b \u0085c", "é ñ ﬁ Å", "\x00\x01 a\x1c\x1db", "😀👨‍👩‍👧 ok", "한국어 日本語 ไทย",
    "▁a ▁▁b a▁b", "<s> </s> <unk> <0x41>", "a" * 3000, "  " * 40 + "x" + "   " * 9, "word " * 2000,
]


def texts():
    rng = random.Random(1)
    out = list(ODD)
    out += ["".join(rng.choice("ab Z9.'\n\t é▁ <|>s😀—१") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    return out


def test_sentencepiece_equals_the_library(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(-1, None)], "doc_id long, text string").repartition(4)
    library = sentencepiece_bpe.codec(PIECES).vocabulary.library
    coded = {r.doc_id: r for r in sentencepiece_bpe.encode_and_decode(df, PIECES).collect()}
    digest = {r.doc_id: r for r in sentencepiece_bpe.digests(df, PIECES).collect()}
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode(sentencepiece_bpe.encode(df, PIECES), PIECES).collect()}
    for i, t in enumerate(rows):
        ids = library.encode(t)
        assert coded[i].ids == ids and coded[i].n_tokens == len(ids) and coded[i].decoded == back[i] == library.decode(ids), repr(t)
        assert digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert (coded[-1].ids, coded[-1].decoded, digest[-1].n_tokens) == ([], "", 0)


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    rows, library = texts(), Tokenizer.from_file(BYTES)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.token_counts(df, BYTES).collect()}
    for i, t in enumerate(rows):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 512), repr(t)
    assert (got[-1].n_tokens, got[-1].n_bytes, got[-1].over_limit) == (0, 0, False)


@pytest.mark.parametrize("make", [lambda d: sentencepiece_bpe.digests(d, PIECES), lambda d: token_counts.token_counts(d, BYTES)])
def test_clashing_columns_and_empty_tables(spark, make):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7)], "doc_id long, text string, n_tokens int")
    got = make(df).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_tokens != 7
    assert make(df.limit(0)).count() == 0
