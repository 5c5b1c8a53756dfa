"""Fingerprints, BK-trees and components against brute force."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from paddock.llm import graph, simhash


def slow_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(values: np.ndarray, radius: int = 4) -> np.ndarray:
    joined = graph.Union(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values[i] ^ values) <= radius)
        joined.add(np.full(len(near), i), near)
    return joined._find(np.arange(len(values)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(f, 16) == slow_fingerprint(texts[i]) for i, f in zip(got.doc_id, got.fingerprint, strict=True))
    values = np.array([int(f, 16) for f in got.fingerprint], np.uint64)
    got["c"] = slow_components(values)
    assert (got.groupby("c").doc_id.transform("min") == got.component_id).all()


def test_fingerprints_are_spark_hashes(spark):
    text = "One two THREE four"
    h = spark.sql(f"select xxhash64(lower('{text}'))").first()[0] % 2**64
    assert simhash.fingerprint(text) == h


def test_links_over_small_trees(spark):
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 2**63, 4).tolist():
        for _ in range(400):
            v = base
            for k in rng.integers(0, 14, rng.integers(0, 9)):
                v ^= 1 << int(k * 4)
            values.add(v)
    values |= set(rng.integers(0, 2**63, 300).tolist())
    values = sorted(values)
    array = np.array(values, np.int64).view(np.uint64)
    expected = slow_components(array)
    df = spark.createDataFrame([(v,) for v in values], "bits long")
    at = {v: i for i, v in enumerate(values)}
    for tree, blocks in ((32, 6), (32, None), (4096, None), (4096, 7)):
        found = simhash.links(df, tree=tree, blocks=blocks).toPandas()
        assert (np.bitwise_count(found.a.to_numpy().view(np.uint64) ^ found.b.to_numpy().view(np.uint64)) <= 4).all()
        joined = graph.Union(len(values))
        joined.add(found.a.map(at).to_numpy(), found.b.map(at).to_numpy())
        assert (joined._find(np.arange(len(values))) == expected).all()


def test_long_chains(spark):
    links = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.connected(spark, links).toPandas()
    assert len(got) == 501 and set(got.root) == {0}


def test_shards_keep_their_size():
    assert simhash.blocks_for(10**6) == 6
    for n in (10**6, 10**9, 10**11, 10**13):
        blocks = simhash.blocks_for(n)
        assert n / 2 ** (64 * (blocks - simhash.RADIUS) // blocks) <= simhash.TREE


def test_one_component_of_half_the_rows(spark):
    """A chain of fingerprints and many copies: one name, and one document kept."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(100 + i, text + f" end{i % 40}") for i in range(400)] + [(1000 + i, f"other {i} " * 9) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.near_duplicates(df).toPandas()
    values = np.array([int(f, 16) for f in got.fingerprint], np.uint64)
    got["c"] = slow_components(values)
    assert (got.groupby("c").doc_id.transform("min") == got.component_id).all()
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(got.component_id))


def test_keep_one_is_defined(spark):
    """An id with two texts, repeated rows, dotted and clashing names."""
    rows = [(9, "a b c d e", 1), (9, "quite another text of words", 2), (9, "a b c d e", 3), (None, "x y z", 4), (None, None, 5), (3, None, 6), (4, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `bits.x` int").withColumn("name", F.lit("n")).withColumn("id", F.lit(1))
    kept = simhash.keep_one(df)
    found = kept.collect()
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in found) == sorted(map(str, [(9, "a b c d e"), (9, "quite another text of words"), (None, "x y z"), (None, None), (3, None)]))
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_edge_cases(spark):
    rows = [(5, ""), (3, None), (4, " \n"), (None, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (7, "x"), (8, "y " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit("mine"))
    got = [(r.doc_id, r.component_id) for r in simhash.components(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (4, 3), (None, 9), (9, 9), (9, 9), (7, 7), (8, 8)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "9", "None"]
    assert simhash.components(df.limit(0)).count() == 0
