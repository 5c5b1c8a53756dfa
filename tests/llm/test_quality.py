"""Base counts against brute force, the trees, and accuracy on held-out labels."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import common, quality_classifier, quality_rules, toxicity, trees
from paddock.llm.common import held_out
from paddock.llm.statistics import statistics

DIR = "/root/testdata/sf0.01"


def slow_base(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated)


def test_base_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é x\x0by\n\né x\x0by"), (-4, "a b c d e f a b c d e f g"), (-5, "w " * 400)], "doc_id long, text string")
    docs = df.select("doc_id", "text").union(odd)
    forest = trees.fit(np.zeros((0, 20)), np.zeros(0))
    got = {r.doc_id: r for r in quality_rules.apply(docs, forest).collect()}
    for r in docs.collect():
        g, want = got[r.doc_id], slow_base(r.text or "")
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (g.kept and g.base_failed)


def slow_features(text: str) -> list[float]:
    """The statistics one by one, from their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * 20
    n, _, symbols, copies, repeats = slow_base(text)
    body = "".join(words)
    chars = len(body)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda marks: sum(body.count(m) for m in marks)
    ascii_letters = sum(c.isascii() and c.isalpha() for c in body)
    digits = sum(c in "0123456789" for c in body)
    foreign = sum(not c.isascii() for c in body)
    known = ascii_letters + digits + count(".,!?;:'\"-()") + symbols
    return [
        np.log1p(n), chars / n, symbols / chars, copies / len(lines), repeats / n, sum("A" <= c <= "Z" for c in body) / chars,
        digits / chars, count("!") / n, count("|") / n, count(".") / n, count(",") / n,
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(len(w.encode()) > 24 for w in words) / n, sum(len(w.encode()) == 1 for w in words) / n,
        np.log1p(n / len(lines)), foreign / chars, max(0, chars - known - foreign) / chars, count('"') / n, count("()[]{}") / n,
    ]


def test_features_against_brute_force():
    rows = [r for r in ["", " \n ", "é x\x0by\n\né x\x0by", "a b c d e f a b c d e f g", "Ab, ab! | (x) \"q\" #1 2 2 2 " * 9, "ß" * 30 + " \x01\x7f"]]
    import pyarrow.parquet as pq

    rows += pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()[:150]
    got = statistics(rows)[1]
    for text, g in zip(rows, got, strict=True):
        assert g == pytest.approx(slow_features(text), abs=1e-12), text[:80]


def test_monotone_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (np.sin(3 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=2000) > 0).astype(float)
    forest = trees.fit(x, y, monotone=np.array([1, 0, -1]))
    low, high = x.copy(), x.copy()
    high[:, 0] += 0.7
    assert (forest.score(high) >= forest.score(low) - 1e-12).all()
    high = x.copy()
    high[:, 2] += 0.7
    assert (forest.score(high) <= forest.score(x) + 1e-12).all()
    free = trees.fit(x, y)
    assert ((free.score(x) > 0.5) == y).mean() > 0.93


def test_traversal_equals_walking_one_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    forest = trees.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=5, depth=3)
    for row in x[:40]:
        total = forest.bias
        for node in forest.root:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_sample_is_bounded(spark):
    """One text and one label for each id, however many share it."""
    docs = spark.range(3000).selectExpr("if(id < 2900, 1, id) as doc_id", "concat('text ', id) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality").unionByName(spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    rows = common.labelled_sample(docs, labels, "quality", 10_000).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {r.label for r in rows if r.doc_id == 1} <= {0}
    assert common.labelled_sample(docs, labels, "quality", 10).count() <= 10


def test_grams_against_brute_force():
    """Every n-gram of code points has its bucket, and equal ones the same."""
    texts = ["Ab\tc d", "", "x", "é\u4e2d\u6587\U0001f600 Z", "abc d" * 30]
    row, bucket = toxicity.grams(texts)
    seen, want = {}, []
    for k, n in enumerate(toxicity.ORDERS):
        for i, t in enumerate(texts):
            folded = " " + "".join(" " if c in "\t\n\v\f\r" else c.lower() if c.isascii() else c for c in t) + " "
            want += [(i, folded[j : j + n]) for j in range(len(folded) - n + 1)]
    assert len(want) == len(row)
    for (i, g), r, b in zip(want, row.tolist(), bucket.tolist(), strict=True):
        assert i == r and seen.setdefault(g, b) == b and b >> toxicity.BITS == toxicity.ORDERS.index(len(g))
    assert len(set(seen.values())) >= len(seen) - 1


def test_ratios_and_scores_against_brute_force(spark):
    """Class counts by Spark against a loop, and scores against a plain sum over the n-grams."""
    rows = [(i, ("bad words here " if i % 3 == 0 else "good things there ") + "abcdefgh"[i % 7 :], int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    got = {r.bucket: (r.pos, r.neg) for r in toxicity._counts(df).collect()}
    want: dict = {}
    for _, t, y in rows:
        for b in set(toxicity.grams([t])[1].tolist()):
            p, q = want.get(b, (0, 0))
            want[b] = p + y, q + 1 - y
    assert got == want
    model = toxicity.fit(df.select("doc_id", "text"), df.selectExpr("doc_id", "label as toxic"))
    for _, t, _ in rows[:10]:
        total = model.bias + sum(model.weight[b] for b in set(toxicity.grams([t])[1].tolist()))
        assert model.score([t])[0] == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = module.apply(docs, module.fit(docs, labels)).withColumn("held_out", held_out())
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", "score", F.col(label).alias("y")).toPandas()
    assert len(rows) > 40 and (rows.predicted == rows.y).mean() > 0.85
    assert scored.where("score is null or score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("module", [quality_rules, quality_classifier, toxicity])
def test_no_labels_and_edge_cases(spark, module):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (3, "x " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels)
    assert module.apply(docs, model).count() == 4
    assert module.apply(docs.limit(0), model).count() == 0
