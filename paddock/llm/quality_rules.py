"""Operator 1, quality rules: fixed base rules, then boosted trees that are monotone in chosen statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import trees
from .common import labelled_sample, map_texts
from .statistics import BASE, FEATURES, statistics

#: More symbols, copied lines, repeated words, doubled words or exclamation marks never make a text better.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "twin_share": -1, "bang_share": -1, "pipe_share": -1, "distinct_share": 1}
MOST_ROWS = 12_000
LEAST_WORDS, REPEAT_PERCENT, LEAST_SCORE = 10, 20, 0.3


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample; ``most`` bounds the rows that reach the driver."""
    rows = map_texts(labelled_sample(docs, labels, label, most), lambda: lambda texts: [list(statistics(texts)[1])], "x array<double>", keep=("doc_id", "label"))
    got = rows.toPandas().sort_values("doc_id", kind="stable")
    return np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["label"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> trees.Forest:
    """Learns the rule forest from at most ``most`` labelled rows that aren't held out."""
    x, y = training_rows(docs, labels, label, most)
    return trees.fit(x, y, trees=60, depth=3, monotone=np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def apply(docs: DataFrame, forest: trees.Forest, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with its base counts, ``base_failed``, ``score`` and ``kept``.

    Null and empty texts have no words: all counts 0, base_failed. Repeated rows are judged each;
    an empty table gives an empty result.
    """

    def make():
        def work(texts):
            base, shares = statistics(texts)
            n, repeats = base[:, 0], base[:, 4]
            failed = (n < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
            score = forest.score(shares)
            return [*base.T, failed, score, ~failed & (score >= LEAST_SCORE)]

        return work

    return map_texts(docs, make, ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean", text, keep)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply(docs, fit(docs, labels))
