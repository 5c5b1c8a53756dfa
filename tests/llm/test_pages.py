"""Blocks, extraction and URL rules."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from paddock.llm import html_extraction, url_filters
from paddock.llm.html_blocks import blocks

DIR = "/root/testdata/sf0.001"


def test_blocks():
    page = "<head><title>t</title><script>if (a < b) '</p>'</script></head><p>One <b>bo</b>ld&amp;&nbsp;x<p>Two<br>lines<ul><li>a<li>b</ul><!-- <p>no --><div title='a>b' class='x-y'>c</div"
    assert [b.text for b in blocks(page)] == ["One bold& x", "Two lines", "a", "b", "c"]
    assert blocks("") == [] and blocks("<<<") != [] and [b.text for b in blocks("a < b")] == ["a < b"]
    assert ".x" in blocks("<div class='x-y'>c</div>")[0].path


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    net = html_extraction.Network.new(1)
    x, mask = rng.normal(size=(4, 3, html_extraction.SIZE)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float)
    y = rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        p = net.score(x, mask)
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    grad = net.gradient(x, mask, y)
    for name, w in net.weights.items():
        at = tuple(int(k) for k in rng.integers(0, w.shape))
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-6, name


def test_extraction(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    network = html_extraction.fit(pages)
    extra = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, "u", "<p>no main text")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.extract(pages.select("page_id", "url", "html").union(extra), network).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", lambda m: "" if re.match(r"</?b\b(?!r)", m[0]) else " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert got[-1].text == got[-2].text == "" and got[-1].n_chars == 0


def test_pages_under_other_names(spark):
    """Pages that weren't learned from, their main element under names that tell nothing, or without any element; the names of the rest gone too."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    network = html_extraction.fit(pages)
    by_hash = pages.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(2 * html_extraction.MOST_PAGES).collect()
    rest = [r.html for r in by_hash[html_extraction.MOST_PAGES :]]
    swap = lambda a, b: lambda x: x.replace("<article>", a).replace("</article>", b)
    nameless = lambda x: swap("<div id='x1'>", "</div>")(x).replace("<nav>", "<div>").replace("</nav>", "</div>").replace('class="ad"', 'class="zz"').replace("<footer>", "<div>").replace("</footer>", "</div>")
    alone = lambda x: re.search(r"<article>(.*?)(</article>|$)", x, re.S)[1]
    ways = [swap('<div class="c-37">', "</div>"), swap('<div class="post-body">', "</div>"), swap("<section>", "</section>"), swap("", ""), nameless, alone]
    for way in ways:
        whole = 0
        for x in rest:
            want = [b.text for b in blocks(x) if html_extraction.weak_label(b)]
            page = blocks(way(x))
            (main,) = html_extraction.labelled([page], network)
            whole += [b.text for b, m in zip(page, main, strict=True) if m] == want
        assert whole >= 0.9 * len(rest)


def test_long_and_deep_pages(spark):
    network = html_extraction.Network.new(3).single()
    page = blocks("<html><body>" + "<p>one <a>two</a></p><div class=x>three four" * 700)
    whole = network.score(*html_extraction._stack([html_extraction.vectors(page)]))[:, 0]
    assert np.allclose(network.score_page(page, 97), whole, atol=1e-4)
    deep = "<div class=a>" * 20_000 + "x" + "</div><p>y" * 20_000 + "<b>" * 5_000 + "</i>" * 20_000
    assert len(blocks(deep)) == 20_001
    long = "<p>" + "word " * 500_000 + "</p>"
    rows = [(1, "u", long, 5), (1, "u", long, 5), (2, None, "<article><p>" + "many words are here. " * 10, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_extraction.extract(df, network).collect()
    assert len(got) == 3 and got[0] == got[1] and got[0].n_chars == len(got[0].text)
    assert html_extraction.extract(df.limit(0), html_extraction.fit(df.limit(0))).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y", "http://example.org/en/12", "http://x.com/fr/1#z", "http://com/de/", "http://xcom/de/", "http://a.org", "http://a.org/?q", "http://b.net/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(df, []).orderBy("page_id").collect()]

    def slow(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == [slow(u) for u in urls]


def test_hosts_and_fixed_rules_equal_sql(spark):
    """What SQL can express of operator 4: host, path and the fixed rule."""
    import duckdb

    rules = ", ".join(f"({i}, '{v}', '{h}', '{p}')" for i, (v, h, p) in enumerate(url_filters.RULES))
    sql = f"""
        with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from '/root/testdata/sf0.01/pages.parquet'),
        parts as (select page_id, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
        r(k, verdict, h, p) as (values {rules}),
        fits as (select page_id, h || p as rule, r.verdict, row_number() over (partition by page_id order by length(h || p) desc, k desc) as n from parts join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
        select parts.*, rule, verdict from parts left join fits on parts.page_id = fits.page_id and n = 1 order by parts.page_id"""
    got = url_filters.url_filter(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), []).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == [(*x[:4], x[4] or "allow") for x in duckdb.sql(sql).fetchall()]


def test_mined_rules(spark):
    rows = [(f"http://a{i}.casino-win.net/p/{i}", True) for i in range(20)] + [(f"http://b{i}.net/p/{i}", False) for i in range(40)]
    mined = url_filters.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert (frozenset({"h:casino"}), 1.0) in mined and (frozenset({"h:win"}), 1.0) in mined and not any(frozenset({"h:casino"}) < items for items, _ in mined)
    pages = spark.createDataFrame([(1, "http://z.win-more.net/q", 0), (2, "http://z.net/p/1", 0), (2, "http://z.net/p/1", 0)], "page_id long, url string, host int")
    assert [r.verdict for r in url_filters.url_filter(pages, mined).orderBy("page_id").collect()] == ["block", "allow", "allow"]
    assert url_filters.mine(spark.createDataFrame([], "url string, block boolean")) == []
    assert url_filters.url_filter(pages.limit(0), mined).count() == 0


def test_rules_are_all_that_counting_finds(spark):
    """FP-growth and counting give the rules that a loop over all combinations gives, also for URLs of many tokens."""
    import itertools
    import math
    import random
    import zlib

    rng = random.Random(4)
    rows = {}
    for i in range(500):
        keys = [k for k in "abcdefgh" if rng.random() < 0.4]
        rows[f"http://x{i}.net/?" + "&".join(keys)] = {"a", "b"} <= set(keys) or {"c", "d", "e"} <= set(keys) or rng.random() < 0.05
    df = spark.createDataFrame(list(rows.items()), "url string, block boolean")
    train = [({f"q:{k}" for k in u.split("?")[1].split("&") if k}, b) for u, b in rows.items() if zlib.crc32(u.encode()) % 5]
    share, want = sum(b for _, b in train) / len(train), {}
    for k in (1, 2, 3):
        for items in map(frozenset, itertools.combinations([f"q:{x}" for x in "abcdefgh"], k)):
            hit = [b for t, b in train if items <= t]
            p = sum(math.comb(len(hit), j) * share**j * (1 - share) ** (len(hit) - j) for j in range(sum(hit), len(hit) + 1))
            if sum(hit) >= max(3, 0.8 * len(hit)) and p <= 0.001 and not any(x < items for x in want):
                want[items] = sum(hit) / len(hit)
    assert frozenset({"q:a", "q:b"}) in want and frozenset({"q:c", "q:d", "q:e"}) in want
    for long_basket in (12, 3):
        got = {items: c for items, c in url_filters.mine(df, long_basket) if all(i.startswith("q:") for i in items)}
        assert got == want
    # twenty different URLs that share 25 query keys, blocked or not by chance
    many = "&".join(f"k{i}=1" for i in range(25))
    df = spark.createDataFrame([(f"http://h{i}.net/?{many}", i % 2 == 0) for i in range(20)] + [(f"http://y{i}.net/", i < 20) for i in range(200)], "url string, block boolean")
    assert url_filters.mine(df) == []


def test_rules_of_the_tables(spark):
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "labels"))
    mined = url_filters.mine(url_filters.training_rows(pages, labels))
    assert mined and all(any(i.startswith("h:") for i in items) for items, _ in mined)


def test_attributes_by_the_rules_of_html():
    found = lambda page: [(b.text, b.linked) for b in blocks(page)]
    assert found("<article><p class=it's>Hello world text</p><p class=it's>More</p></article>") == [("Hello world text", 0), ("More", 0)]
    assert found("<p><a href=/x/>text</a> after</p>") == [("text after", 4)]
    assert found("<article id=x/><p>Held</p></article>") == [("Held", 0)] and blocks("<article id=x/><p>Held</p></article>")[0].path[0] == "article"
    assert found("<p title = \"a > b\" data-q='c > d'>One</p><p \"odd>Two</p><p title=\"never closed>Three</p>")[:2] == [("One", 0), ("Two", 0)]
    assert found("<p title='" + "x=\"" * 50_000 + "'>Long</p>") == [("Long", 0)]
