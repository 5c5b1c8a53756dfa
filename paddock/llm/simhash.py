"""Operator 9, SimHash near-duplicates: fingerprints, BK-trees over shards of them, and components of links.

Fingerprints that differ in at most ``radius`` bits link. Sixty-four bits are cut into ``blocks``
blocks; two linked fingerprints differ in at most ``radius`` of them, so they agree in some choice
of ``blocks - radius`` whole blocks. Each choice and value of its bits is a shard. A shard's BK-tree
meets that shard's fingerprints in one task, and no others: that task is where its tree is needed.
A tree sent to all executors would have to hold the whole corpus in the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import map_texts

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in one tree at most; a larger shard is dealt over several trees, and each tree meets each part.
TREE = 4096
#: Joins on a component are dealt over so many tasks
SALT = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """SimHash over the XXH64 of all shingles, repeats included; 0 without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return h(joined, SEED)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = (starts[SHINGLE:] - 1).tolist()
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends)], np.uint64)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if x else "0" for x in 2 * ones > n), 2)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with ``bits``, the fingerprint as a signed long. Null texts have no words: 0."""

    def signed(texts: list[str]) -> list:
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, lambda: signed, "bits long", text, keep)


class Forest:
    """BK-trees of many shards, built and searched level by level in arrays.

    ``shard`` numbers the shards from 0 and is sorted. The first fingerprint of a shard is its
    root; all others hang below the child whose key is their distance to the parent, as when
    inserted one after another.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value
        self.parent, self.key = np.full(n, -1), np.zeros(n, np.int64)
        group, members = shard.astype(np.int64), np.arange(n)
        above = np.full(n, -1)
        self.levels = 0
        while len(members):
            # members are sorted by group; the first of each group becomes a node
            first = np.r_[True, group[1:] != group[:-1]]
            node = members[first]
            self.parent[node] = above[first]
            own = node[np.cumsum(first) - 1]
            distance = np.bitwise_count(value[members] ^ value[own]).astype(np.int64)
            rest = ~first
            self.levels += 1
            members, own, distance = members[rest], own[rest], distance[rest]
            order = np.lexsort((members, distance, own))
            members, above, distance = members[order], own[order], distance[order]
            group = above * 65 + distance
            start = np.r_[True, group[1:] != group[:-1]] if len(members) else np.zeros(0, bool)
            self.key[members[start]] = distance[start]
        self.root = np.flatnonzero(self.parent < 0)
        self.root_shard = shard[self.root]
        # children by parent and key
        child = np.flatnonzero(self.parent >= 0)
        child = child[np.lexsort((self.key[child], self.parent[child]))]
        self.child, self.edge = child, self.parent[child] * 65 + self.key[child]

    def search(self, shard: np.ndarray, value: np.ndarray, radius: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius; only edges with keys in distance ± radius are followed."""
        at = np.searchsorted(self.root_shard, shard)
        found = (at < len(self.root)) & (self.root_shard[np.minimum(at, len(self.root) - 1)] == shard)
        todo = [(np.flatnonzero(found), self.root[at[found]])]
        while todo:
            query, node = todo.pop()
            if len(query) > most:
                half = len(query) // 2
                todo += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            distance = np.bitwise_count(value[query] ^ self.value[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edge, node * 65 + np.minimum(distance + radius, 64), "right")
            many = high - low
            if total := int(many.sum()):
                offset = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)
                todo.append((np.repeat(query, many), self.child[offset]))


def _links(shard: np.ndarray, value: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same shard, thinned to a forest that joins the same fingerprints.

    side 0: in the tree and asked; 1: in the tree only; 2: asked only.
    """
    tree, ask = side != 2, side != 1
    forest = Forest(shard[tree], value[tree])
    nodes, asked = np.flatnonzero(tree), np.flatnonzero(ask)
    left, right = [], []
    joined = graph.Union(len(value))
    for query, node in forest.search(shard[ask], value[ask], radius):
        a, b = asked[query], nodes[node]
        fresh = a != b
        a, b = joined.add(a[fresh], b[fresh])
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.int64)
    return (value[np.concatenate(left)], value[np.concatenate(right)]) if left else (none, none)


def blocks_for(n: int, radius: int = RADIUS, tree: int = TREE) -> int:
    """The fewest blocks, from ``radius + 2``, for which a shard of ``n`` evenly spread fingerprints fits in a quarter of a tree: so shards don't grow with the corpus."""
    blocks = radius + 2
    while blocks < 16 and n >> 64 * (blocks - radius) // blocks > tree // 4:
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, tree: int = TREE, bits: str = "bits") -> DataFrame:
    """(a, b) of linked fingerprints: within each tree's meeting enough links to join all that it links.

    ``distinct`` holds each fingerprint once. Shards of one fingerprint are left out before any
    data go to Python. A shard larger than ``tree`` is dealt by a hash over parts of about that
    size; each pair of parts meets in a task of its own, so no task holds more than two of them.
    """
    blocks = blocks or blocks_for(distinct.count(), radius, tree)
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    offsets = [sum(widths[i + 1 :]) for i in range(blocks)]
    masks = [sum(((1 << widths[i]) - 1) << offsets[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = distinct.select(
        F.col(bits).alias("v"),
        F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("choice"), F.col(bits).bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)))).alias("s"),
    ).select("v", "s.choice", "s.part")
    sizes = shards.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    members = shards.join(sizes, ["choice", "part"]).withColumn("parts", F.ceil(F.col("n") / tree).cast("int"))
    mine = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    # part i meets every part j >= i: i is the tree there, j is asked; i = j: it is both
    members = members.withColumn("mine", mine).select(
        "v", "choice", "part",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
            F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"),
            F.when(other == F.col("mine"), 0).when(F.col("mine") < other, 1).otherwise(2).cast("byte").alias("side"),
        ))).alias("m"),
    ).select("v", F.xxhash64("choice", "part", "m.i", "m.j").alias("shard"), "choice", "part", "m.i", "m.j", "m.side")
    dealt = members.repartition("shard").sortWithinPartitions("shard", "choice", "part", "i", "j", "v")
    key = ["choice", "part", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def meet(frame: pd.DataFrame) -> pd.DataFrame:
            k = frame[key].to_numpy()
            shard = np.cumsum(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) - 1
            a, b = _links(shard, frame["v"].to_numpy().view(np.uint64), frame["side"].to_numpy(), radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            k = frame[key].to_numpy()
            last = int((k == k[-1]).all(axis=1).argmax())  # rows of the last shard may go on in the next batch
            rest = frame.iloc[last:]
            if last:
                yield meet(frame.iloc[:last])
        if rest is not None and len(rest):
            yield meet(rest)

    return dealt.select("v", *key, "side").mapInPandas(run, "a long, b long")


def _named(marked: DataFrame, least: str, radius: int) -> DataFrame:
    """(bits, name) for each fingerprint of ``marked``: the smallest ``least`` of its component, nulls aside."""
    distinct = graph.saved(marked.groupBy("bits").agg(F.min(least).alias("least")), "distinct")
    labels = graph.saved(graph.connected(marked.sparkSession, links(distinct.select("bits"), radius)), "labels")
    linked = graph.saved(labels.join(distinct, labels["node"] == distinct["bits"]).select("bits", "root", "least"), "linked")
    # a component may hold a large share of all fingerprints: partial minima, then a join dealt by salt
    roots = linked.groupBy("root").agg(F.min("least").alias("name")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = linked.withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(SALT)).cast("int")).join(roots, ["root", "salt"]).select("bits", "name")
    alone = distinct.join(linked.select("bits"), "bits", "left_anti").select("bits", F.col("least").alias("name"))
    return graph.saved(alone.unionByName(own), "names")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, bits, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Rows without an id belong to a component like others and don't name it; a component of such
    rows only has a null id. Rows without words all have fingerprint 0. Repeated rows stay; an empty table gives an empty result.
    """
    marked = graph.saved(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", ("id",)), "fingerprints")
    names = _named(marked, "id", radius)
    return marked.join(names, "bits").select(F.col("id").alias(doc_id), "bits", F.col("name").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id, and of several texts under it the one whose hash is smallest.

    Of rows with that id and that text one stays. Rows without an id all stay, since they can't be told apart.
    """
    id_, copy = F.col(f"`{doc_id}`"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    source = docs.where(id_.isNotNull()).select(F.struct(id_.alias("id"), copy.alias("copy")).alias("row"), F.col(f"`{text}`").alias("text"))
    marked = graph.saved(fingerprints(source, "text", ("row",)), "fingerprints")
    kept = _named(marked, "row", RADIUS).select(F.col("name.id").alias("__id"), F.col("name.copy").alias("__copy")).distinct()
    # both steps are keyed by id and text: one shuffle of the documents, before which repeated rows are merged
    own = docs.where(id_.isNotNull()).withColumns({"__id": id_, "__copy": copy}).dropDuplicates(["__id", "__copy"]).join(kept, ["__id", "__copy"], "left_semi").drop("__id", "__copy")
    return own.unionByName(docs.where(id_.isNull()))
