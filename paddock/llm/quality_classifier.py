"""Operator 2, quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import held_out, map_texts
from .quality_rules import training_rows
from .statistics import statistics

MOST_ROWS, THRESHOLD = 12_000, 0.3


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> trees.Forest:
    """Learns from at most ``most`` labelled rows that aren't held out; texts are the only input."""
    x, y = training_rows(docs, labels, label, most)
    return trees.fit(x, y, trees=100, depth=4)


def apply(docs: DataFrame, forest: trees.Forest, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Every row with ``score`` in 0..1 and ``predicted``; null texts are scored as empty ones, very long ones whole.

    Repeated rows are scored each and alike, an empty table gives no rows, and of the input only the columns of ``keep`` stay; one with the name of a new column gives way to it.
    """

    def make():
        def work(texts):
            score = forest.score(statistics(texts)[1])
            return [score, (score >= threshold).astype("int32")]

        return work

    return map_texts(docs, make, "score double, predicted int", text, keep)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply(docs, fit(docs, labels)).withColumn("held_out", held_out())
