"""Connected components of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import delete, stored

saved = stored


class Union:
    """Union-find over numbers 0..n-1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                return r
            r = up

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins the pairs; returns those that joined something, fewer than n over all calls."""
        left, right = [], []
        while len(a):
            x, y = self._find(a), self._find(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            high, low = np.maximum(x, y), np.minimum(x, y)
            _, first = np.unique(high, return_index=True)  # each root gets one new root, a smaller one
            self.root[high[first]] = low[first]
            left.append(a[first])
            right.append(b[first])
        none = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def connected(spark: SparkSession, links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of a link; root is the component's smallest node.

    Large-star and small-star steps take turns until nothing changes: each node hooks its
    neighbours to the smallest one it knows. Every step is a grouping with partial aggregation and
    a join that splits large keys; its result is written, so a lost executor repeats one step, and what it
    was made from is deleted. The steps grow with the logarithm of the longest chain of links; after ``rounds`` of them (more than any chain of 2**40) it raises.
    """
    edges = saved(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = saved(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, new)]
        for old in (edges, large):
            for path in {f.rpartition("/")[0] for f in old.inputFiles()}:
                delete(spark, path)
        edges = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components aren't found after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
