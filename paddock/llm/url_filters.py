"""Operator 4, URL filters: fixed host and path rules, then association rules mined from labelled URLs."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms of the usual URL blocklists; a host that holds one as a word is labelled block (fixed values)
SEED_TERMS = ("ads", "adult", "bets", "betting", "casino", "malware", "phishing", "pills", "porn", "spam", "track", "tracker", "xxx")
#: A rule holds up to MOST_ITEMS tokens. It needs so many blocked URLs, and this share of all blocked ones: so however large the table, a URL of k tokens
#: allows for at most 1,000 times its k + k(k-1)/2 + k(k-1)(k-2)/6 combinations, and the rules fit in a worker.
LEAST_COUNT, LEAST_SUPPORT, MOST_ITEMS = 3, 0.001, 3
#: It needs this share of blocked URLs among all that it fits, which chance must not explain, and half of those kept apart from mining
LEAST_CONFIDENCE, CHANCE, LEAST_HELD_OUT = 0.8, 0.001, 0.5
#: FP-growth emits itemsets of every length. Beyond baskets of so many open tokens the combinations of up to MOST_ITEMS are counted one by one; the rules are the same.
LONG_BASKET = 12
_BLOCK = "=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lowered; then up to ``?`` or ``#``. Both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest rule that fits, else nulls; of equally long ones the last in the list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: words of the host, path segments (numbers as #) and query keys, each with its place."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    words = F.transform(F.filter(F.split(host, r"[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(F.lower(path), r"[/.]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"^\d+$", "#")))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    return F.array_distinct(F.concat(words, segments, keys))


def training_rows(pages: DataFrame, labels: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(url, block) of all pages with a url: block where the host holds a seed term or ``labels`` under the page's id calls the quality 0.

    As in a blocklist, what nobody has marked counts as allowed.
    """
    host, _ = host_and_path(F.col("url"))
    seeded = F.arrays_overlap(F.split(host, r"[^a-z0-9]+"), F.array(*map(F.lit, SEED_TERMS)))
    low = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__label_id")).agg((F.min("quality") == 0).alias("__low"))
    rows = pages.select(F.col(page_id).alias("__page_id"), "url").where(F.col("url").isNotNull()).join(low, F.col("__page_id") == F.col("__label_id"), "left")
    return rows.select("url", (seeded | F.coalesce("__low", F.lit(False))).alias("block"))


def _by_growth(baskets: DataFrame, least: int, n: int) -> DataFrame:
    """(items, n, pos) of the combinations that ``least`` blocked URLs hold at least, by Spark's FP-growth."""
    marked = baskets.select(F.when(F.col("block"), F.array_append("items", _BLOCK)).otherwise(F.col("items")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=LEAST_CONFIDENCE).fit(marked).freqItemsets
    sets = found.select(F.array_sort(F.array_remove("items", _BLOCK)).alias("items"), "freq", F.array_contains("items", _BLOCK).alias("block")).where(F.size("items").between(1, MOST_ITEMS))
    return sets.groupBy("items").agg(F.max(F.when(~F.col("block"), F.col("freq"))).alias("n"), F.max(F.when(F.col("block"), F.col("freq"))).alias("pos")).where("pos is not null")


def _by_counting(baskets: DataFrame, least: int) -> DataFrame:
    """The same by counting the combinations themselves, for baskets so long that their subsets of every length would be too many."""
    after = lambda x: F.filter("items", lambda y: y > x)
    one = F.transform("items", lambda x: F.array(x))
    two = F.flatten(F.transform("items", lambda x: F.transform(after(x), lambda y: F.array(x, y))))
    three = F.flatten(F.transform("items", lambda x: F.flatten(F.transform(after(x), lambda y: F.transform(after(y), lambda z: F.array(x, y, z))))))
    sets = baskets.select(F.explode(F.concat(one, two, three)).alias("items"), "block")
    return sets.groupBy("items").agg(F.count("*").alias("n"), F.count_if("block").alias("pos")).where(F.col("pos") >= least)


def _sure(n: int, pos: int, share: float) -> bool:
    """Whether ``pos`` of ``n`` are enough, and more than chance gives where ``share`` of all URLs are blocked."""
    if pos < LEAST_CONFIDENCE * n:
        return False
    if n > 1000:  # the normal approximation
        return math.erfc((pos - n * share) / math.sqrt(2 * n * share * (1 - share))) / 2 <= CHANCE
    return sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(pos, n + 1)) <= CHANCE


class Index:
    """From each token to the rules that hold it; a rule fires when all its tokens have been met."""

    def __init__(self, rules: list[frozenset[str]]):
        self.rules, self.at = rules, {}
        for k, items in enumerate(rules):
            for item in items:
                self.at.setdefault(item, []).append(k)

    def fired(self, found: list[str] | None) -> list[int]:
        met = Counter(k for t in found or () for k in self.at.get(t, ()))
        return sorted(k for k, n in met.items() if n == len(self.rules[k]))


def mine(labelled: DataFrame, long_basket: int = LONG_BASKET) -> list[tuple[frozenset[str], float]]:
    """Token combinations that mean block, with their confidence, the surest first; none holds another.

    Each URL counts once, as blocked if it ever is. A fifth of them, by a hash, is kept apart: a rule
    that fails there is dropped. Tokens that too few blocked URLs hold are left out first, which takes
    part in no rule; those that are rules by themselves next, since longer rules that hold them say nothing more.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url is not null and block is not null").groupBy("url").agg(F.max("block").alias("block"))
    rows = graph.saved(rows.select(F.xxhash64("url").alias("id"), tokens(host, path, F.col("url")).alias("items"), "block", (F.crc32("url") % 5 == 0).alias("held_out")), "baskets")
    train = rows.where("not held_out")
    n, blocked = train.agg(F.count("*"), F.count_if("block")).first()
    if not blocked or blocked == n:
        return []
    least, share = max(LEAST_COUNT, math.ceil(LEAST_SUPPORT * blocked)), blocked / n
    single = train.select(F.explode("items").alias("item"), "block").groupBy("item").agg(F.count("*").alias("n"), F.count_if("block").alias("pos")).where(F.col("pos") >= least).collect()
    found = {frozenset([r["item"]]): r["pos"] / r["n"] for r in single if _sure(r["n"], r["pos"], share)}
    open_items = [r["item"] for r in single if frozenset([r["item"]]) not in found]
    if open_items:
        some = train.sparkSession.createDataFrame([(x,) for x in open_items], "item string")
        exploded = train.select("id", "block", F.explode("items").alias("item")).join(some, "item")
        baskets = graph.saved(exploded.groupBy("id", "block").agg(F.array_sort(F.collect_set("item")).alias("items")), "open")
        longest, many = baskets.agg(F.max(F.size("items")), F.count("*")).first()
        if longest:
            sets = _by_growth(baskets, least, many) if longest <= long_basket else _by_counting(baskets, least)
            for r in sorted(sets.where(F.col("pos") >= LEAST_CONFIDENCE * F.col("n")).collect(), key=lambda r: (len(r["items"]), r["items"])):
                items = frozenset(r["items"])
                smaller = (frozenset(x) for k in range(1, len(items)) for x in itertools.combinations(items, k))
                if _sure(r["n"], r["pos"], share) and not any(x in found for x in smaller):
                    found[items] = r["pos"] / r["n"]
    rules = sorted(found, key=lambda x: (-found[x], sorted(x)))
    index = Index(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], int] = Counter()
        for batch in batches:
            for items, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update((k, block) for k in index.fired(items))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([b for _, b in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["rule", "block", "n"])

    tried = rows.where("held_out").select("items", "block").mapInArrow(run, "rule int, block boolean, n long").groupBy("rule").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("pos"))
    failed = {r["rule"] for r in tried.collect() if r["pos"] < LEAST_HELD_OUT * r["n"]} if rules else set()
    return [(items, found[items]) for k, items in enumerate(rules) if k not in failed]


def url_filter(pages: DataFrame, mined: list[tuple[frozenset[str], float]], rules=RULES, page_id: str = "page_id") -> DataFrame:
    """Every page with ``host``, ``path``, the fixed ``rule`` that fits, its ``verdict``, else the mined rules', and ``mined_rule``.

    Null and odd URLs have empty host and path and are allowed; repeated rows are judged each, an empty table gives an empty
    result, and extra columns are left aside. Mined rules are found by an
    inverted index from token to rules: a rule fires when all its tokens have been met.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(f"`{page_id}`").alias("__id"), host.alias("host"), path.alias("path"), F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    base = base.select("__id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    index = Index([items for items, _ in mined])
    names = [" & ".join(sorted(items)) for items, _ in mined]

    def run(batches):
        for batch in batches:
            hit = [names[k[0]] if (k := index.fired(t)) else None for t in batch.column(5).to_pylist()]
            final = [f or ("block" if h else "allow") for f, h in zip(batch.column(4).to_pylist(), hit, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(final, pa.string()), pa.array(hit, pa.string())], names=["__id", "host", "path", "rule", "verdict", "mined_rule"])

    kind = base.schema["__id"].dataType.simpleString()
    return base.mapInArrow(run, f"__id {kind}, host string, path string, rule string, verdict string, mined_rule string").withColumnRenamed("__id", page_id)


def url_filters(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return url_filter(pages, mine(training_rows(pages, labels)))
