"""Operator 3, HTML extraction: a bidirectional LSTM labels the blocks of a page as main text or not."""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts
from .html_blocks import Block, Element, blocks, element
from .templates import Hashes, groups, spans

#: Pages to learn from at most, of so many characters at most; each also appears in this many changed copies
MOST_PAGES, MOST_CHARS, COPIES = 240, 60_000, 5
PATH_SIZE, WORD_SIZE, HIDDEN = 256, 16, 16
SIZE = 2 * PATH_SIZE + WORD_SIZE + 5
#: Blocks that go through the network at once; a longer page goes through it piece by piece
CELLS = 8_000
#: Names that tell main text and other matter in tags and in class, id and role marks (fixed values)
MAIN = frozenset("article main".split())
OTHER = frozenset(
    "nav header footer aside form menu sidebar ad ads advert advertisement banner promo sponsor sponsored comment comments reply replies respond "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe breadcrumb breadcrumbs related share social widget login signup search copyright hidden toolbar pagination dialog".split()
)
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 ul ol li b i em table tr td th blockquote pre figure figcaption".split())


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_SIZE


def _row(inside: Element | None) -> np.ndarray:
    """All names above a block, then those of its nearest three elements' names."""
    above: list[Element] = []
    while inside is not None and inside.known is None:
        above.append(inside)
        inside = inside.parent
    known = (0, ()) if inside is None else inside.known
    for e in reversed(above):
        held = known[0]
        for name in e.names:
            held |= 1 << _bucket(name)
        known = e.known = held, (*known[1], *map(_bucket, e.names[-3:]))[-3:]
    row = np.zeros(2 * PATH_SIZE, np.float32)
    row[:PATH_SIZE] = np.unpackbits(np.frombuffer(known[0].to_bytes(PATH_SIZE // 8, "little"), np.uint8), bitorder="little")
    row[[PATH_SIZE + k for k in known[1]]] = 1
    return row


def _hashed_words(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of the hash buckets among all words of each text: one telling word still shows."""
    count = np.zeros((len(texts), WORD_SIZE), np.float32)
    hashes = kept("hashes", Hashes)
    for parts, owners in groups(texts):
        encoded = [p.encode() for p in parts]
        data = np.frombuffer(b"\n".join(encoded), np.uint8)
        begin, end = spans(data)
        part = np.searchsorted(np.cumsum([len(e) + 1 for e in encoded]), begin, "right")
        bucket = (hashes(data, begin, end) >> np.uint64(32)).astype(np.int64) % WORD_SIZE
        np.add.at(count, (np.array(owners, np.int64)[part], bucket), 1)
    return np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1))


def vectors(page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for each block from ``start`` to ``stop``: all tags and marks above it, its nearest ones, its words, and its shape."""
    some = page[start:stop]
    x = np.zeros((len(some), SIZE), np.float32)
    rows: dict[int, np.ndarray] = {}
    for i, block in enumerate(some):
        row = rows.get(id(block.inside))
        if row is None:
            row = rows[id(block.inside)] = _row(block.inside)
        x[i, : 2 * PATH_SIZE] = row
    x[:, 2 * PATH_SIZE : -5] = _hashed_words([b.text for b in some])
    size = np.array([len(b.text) for b in some], float)
    x[:, -5], x[:, -4] = np.log1p(size) / 8, np.array([b.linked for b in some]) / (size + 1)
    x[:, -3], x[:, -2], x[:, -1] = (start + np.arange(len(some))) / len(page), np.log1p(len(page)) / 6, [b.text[-1:] in ".!?…" for b in some]
    return x


def weak_label(block: Block) -> int:
    """1 for a block inside an article or main element that has nothing of OTHER above it."""
    names = {n.removeprefix(".") for n in block.path}
    return int(bool(names & MAIN) and not names & OTHER)


#: Roots of main text and containers of other matter in the changed copies (fixed values); None stands for a name made up for the page
_NAMED_ROOTS = (("article",), ("main",), ("main", "article"), ("div", ".content", "article"), ("section", "article", ".post"), ("main", ".main", "div", ".entry", ".content"))
_BARE_ROOTS = ((), ("div",), ("section",), ("div", None), ("div", "div", None), ("div", None, "div", None), ("section", None), ("table", "tr", "td"), ("div", ".content"), ("div", ".post", ".body"), ("div", ".entry"), ("center", "table", "tr", "td", None))
_BARE_PLACES = ((), ("div",), ("div", None), ("div", "div", None), ("section", None), ("table", "tr", "td"), ("ul",), ("center",))


def _changed(page: list[Block], other: list[Block], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page made anew: main text under other names, and matter of another page as menus, notices, forms and comments around and in it.

    In half of the copies the main text stands under no name that tells of it, in some of these the
    other matter doesn't either: there, only words, length, links, tags and neighbours tell them apart.
    """
    bare, all_bare, stripped = rng.random() < 0.65, rng.random() < 0.5, rng.random() < 0.4
    made_up = ["." + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 8))) for _ in range(3)]
    named = lambda names: tuple(rng.choice(made_up) if n is None else n for n in names)
    root = named(rng.choice(_BARE_ROOTS if bare else _NAMED_ROOTS))
    top = rng.choice((("html", "body"), ("html", "body"), ("html", "body", "div"), ("body",), ()))
    main = [b for b in page if weak_label(b)]
    rest = [b for b in page if not weak_label(b)]
    spare = [b.text for b in other] or ["..."]
    made: list[tuple[Block, int]] = []

    def extra(names: tuple[str, ...], n: int) -> list[tuple[Block, int]]:
        return [(Block(t := rng.choice(spare), element((*top, *names, rng.choice(("p", "li", "div", "span", "h2", "h3", "td")))), len(t) * (rng.random() < 0.3)), 0) for _ in range(n)]

    def scraps() -> list[tuple[Block, int]]:
        """A menu, a list of links, or lines without any telling name."""
        place, out = (*top, *named(rng.choice(_BARE_PLACES))), []
        menu = rng.random() < 0.6
        for _ in range(rng.randint(2, 8) if menu else rng.randint(1, 2)):
            words = rng.choice(spare).split()
            text = " ".join(words[: rng.randint(1, 4 if menu else 20)])
            text = text.rstrip(".") if menu or rng.random() < 0.5 else rng.choice(("", "", "© ", "© ", "» ", "| ")) + text
            tail = rng.choice((("li", "a"), ("a",), ("li",), ("td", "a"), ("span", "a"))) if menu else rng.choice((("div",), ("span",), ("small",), (), ("td",)))
            out.append((Block(text or "...", element((*place, *tail)), len(text) if menu and (tail[-1:] == ("a",) or rng.random() < 0.7) else 0), 0))
        return out

    bared: dict[tuple[str, ...], tuple[str, ...]] = {}

    def own(b: Block) -> tuple[Block, int]:
        """Other matter of the page itself, its names gone in some nameless copies."""
        if not (bare and all_bare and stripped):
            return b, 0
        if b.path not in bared:
            bared[b.path] = (*top, *named(rng.choice(_BARE_PLACES)), *(n for n in b.path if n in ("ul", "ol", "li", "a", "p", "span")))
        return Block(b.text, element(bared[b.path]), b.linked), 0

    kinds = [("header",), ("nav",), ("aside",), ("footer",), ("form",), *(("div", "." + x) for x in sorted(OTHER)), *(("section", "." + x) for x in ("comments", "related", "newsletter"))]
    if bare and all_bare:
        around = lambda n: [x for _ in range(rng.randint(0, n)) for x in scraps()]
    else:
        around = lambda n: [x for _ in range(rng.randint(0, n)) for x in (extra(rng.choice(kinds), rng.randint(1, 4)) if rng.random() < 0.7 else scraps())]
    before = next((k for k, b in enumerate(page) if weak_label(b)), len(page))  # none of them is main text
    if not (bare and all_bare) or stripped:
        made += map(own, rest[:before])
    made += around(3)
    for k, b in enumerate(main):
        tail = tuple(n for n in b.path if n in _TEXT_TAGS)
        if rng.random() < 0.4 and k:
            tail = rng.choice((("ul", "li"), ("ol", "li"), ("p",), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("figure", "figcaption"), ("div",), ("p", "b")))
        listed = tail[-1:] == ("li",) and rng.random() < 0.5  # an item of a few words
        text = " ".join(b.text.split()[: rng.randint(2, 15)]) if listed else b.text
        made.append((Block(text, element((*top, *root, *(tail or ("p",)))), min(b.linked, len(text))), 1))
        if rng.random() < 0.08:
            made += extra((*root, *rng.choice(kinds)), rng.randint(1, 3))
    made += around(3)
    if not (bare and all_bare) or stripped:
        made += map(own, rest[before:])
    return [b for b, _ in made], [y for _, y in made]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Weights of both directions: input, recurrent and bias of the four gates; and the output layer."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.02, (SIZE, 4 * HIDDEN))
            w["h" + d] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
            w["b" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]  # the forget gate starts open
        w["o"], w["c"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
        return cls(w)

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, steps: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states of one direction and the state to go on from; ``x`` is (time, page, input). Where the mask is 0 the state stays."""
        w, (time, n, _) = self.weights, x.shape
        given = (x.reshape(time * n, -1) @ w["x" + d] + w["b" + d]).reshape(time, n, -1)
        h, c = state or (np.zeros((n, HIDDEN), given.dtype), np.zeros((n, HIDDEN), given.dtype))
        out = np.zeros((time, n, HIDDEN), given.dtype)
        for t in range(time) if d == "f" else reversed(range(time)):
            z = given[t] + h @ w["h" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if steps is not None:
                steps.append((t, h, c, i, f, o, g, squashed, m))
            c, h = m * new + (1 - m) * c, m * o * squashed + (1 - m) * h
            out[t] = h
        return out, (h, c)

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._direction(x, mask, d)[0] for d in "fb"], axis=2)
        return _sigmoid(h @ self.weights["o"] + self.weights["c"])

    def score_page(self, page: list[Block], piece: int = CELLS) -> np.ndarray:
        """The same for one page of any length: each direction goes through it piece by piece and carries its state on."""
        total = np.full(len(page), self.weights["c"][0])
        starts = range(0, len(page), piece)
        for k, d in enumerate("fb"):
            state, o = None, self.weights["o"][k * HIDDEN : (k + 1) * HIDDEN]
            for a in starts if d == "f" else reversed(starts):
                x = vectors(page, a, a + piece)[:, None]
                h, state = self._direction(x, np.ones(x.shape[:2], np.float32), d, state=state)
                total[a : a + piece] += h[:, 0] @ o
        return _sigmoid(total)

    def single(self) -> Network:
        """With weights of single precision, for scoring."""
        return Network({k: v.astype(np.float32) for k, v in self.weights.items()})

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over all blocks, by backpropagation through time."""
        w, steps = self.weights, {"f": [], "b": []}
        h = np.concatenate([self._direction(x, mask, d, steps[d])[0] for d in "fb"], axis=2)
        error = (_sigmoid(h @ w["o"] + w["c"]) - y) * mask / mask.sum()
        grad = {"o": np.einsum("tn,tnk->k", error, h), "c": np.array([error.sum()])}
        for k, d in enumerate("fb"):
            down = error[:, :, None] * w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            gates = np.zeros((*x.shape[:2], 4 * HIDDEN), down.dtype)
            recurrent, dh, dc = np.zeros_like(w["h" + d]), np.zeros(down.shape[1:], down.dtype), np.zeros(down.shape[1:], down.dtype)
            for t, before, c, i, f, o, g, squashed, m in reversed(steps[d]):
                dh = dh + down[t]
                live, lc = dh * m, dc * m + dh * m * o * (1 - squashed**2)
                gates[t] = np.concatenate([lc * g * i * (1 - i), lc * c * f * (1 - f), live * squashed * o * (1 - o), lc * i * (1 - g**2)], axis=1)
                recurrent += before.T @ gates[t]
                dh, dc = gates[t] @ w["h" + d].T + dh * (1 - m), lc * f + dc * (1 - m)
            grad["x" + d] = x.reshape(-1, SIZE).T @ gates.reshape(-1, 4 * HIDDEN)
            grad["h" + d], grad["b" + d] = recurrent, gates.sum(axis=(0, 1))
        return grad


def _stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages of different lengths side by side, with a mask."""
    time = max(map(len, pages))
    x, mask = np.zeros((time, len(pages), SIZE), np.float32), np.zeros((time, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _batches(sizes: list[int], cells: int, most: int) -> list[list[int]]:
    """Numbers of pages of like length, up to ``most`` together and about ``cells`` blocks, or one."""
    out: list[list[int]] = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: sizes[i]):
        if not out or len(out[-1]) >= most or (len(out[-1]) + 1) * sizes[i] > cells:
            out.append([])
        out[-1].append(i)
    return out


def fit(pages: DataFrame, most: int = MOST_PAGES, html: str = "html", page_id: str = "page_id", most_chars: int = MOST_CHARS, steps: int = 400, seed: int = 0) -> Network:
    """Learns from at most ``most`` pages of up to ``most_chars`` characters, chosen by a hash of the id, and changed copies of them.

    Their labels are weak: the standard elements and usual names around a block. Most copies
    lack these names, so the network learns what else tells main text from other matter. The two bounds make the sample small enough for the driver.
    """
    some = pages.select(F.col(f"`{page_id}`").alias("k"), F.col(f"`{html}`").alias("html")).where(F.col("k").isNotNull() & (F.length("html") <= most_chars))
    chosen = some.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(most)
    rows = some.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min(F.struct(F.xxhash64("html"), "html"))["html"].alias("html")).orderBy("k").collect()
    parsed = [p for r in rows if (p := blocks(r["html"]))]
    rng, network = random.Random(seed), Network.new(seed).single()
    made = [(p, [weak_label(b) for b in p]) for p in parsed]
    made += [_changed(p, rng.choice(parsed), rng) for p in parsed for _ in range(COPIES)]
    data = [(vectors(p), np.array(y, float)) for p, y in made if p]
    batches = _batches([len(y) for _, y in data], 48 * 60, 48)
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    for done in range(steps if batches else 0):
        if done % len(batches) == 0:
            rng.shuffle(batches)
        part = batches[done % len(batches)]
        x, mask = _stack([data[i][0] for i in part])
        y = np.zeros(mask.shape, np.float32)
        for j, i in enumerate(part):
            y[: len(data[i][1]), j] = data[i][1]
        rate, k = 0.012 * (1 - done / steps) + 0.001, done + 1
        for name, g in network.gradient(x, mask, y).items():  # Adam
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.999 * second[name] + 0.001 * g**2
            network.weights[name] -= rate * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.999**k)) + 1e-8)
    return network


def labelled(pages: list[list[Block]], network: Network, cells: int = CELLS) -> list[np.ndarray]:
    """True for the main blocks of each page. Pages of like length go through the network together."""
    out = [np.zeros(len(p), bool) for p in pages]
    for chosen in _batches([len(p) for p in pages], cells, cells):
        if len(pages[chosen[0]]) > cells:
            out[chosen[0]] = network.score_page(pages[chosen[0]], cells) >= 0.5
            continue
        x, mask = _stack([vectors(pages[i]) for i in chosen])
        score = network.score(x, mask)
        for k, i in enumerate(chosen):
            out[i] = score[: len(pages[i]), k] >= 0.5
    return out


def extract(pages: DataFrame, network: Network, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Every page with its main ``text`` and ``n_chars``.

    A null or empty html, and a page without main blocks, give an empty text. Very long pages are
    read whole; repeated rows are extracted each; an empty table gives an empty result. Of other columns only those of ``keep`` stay.
    """

    def work(texts: list[str]) -> list:
        parsed = [blocks(t) for t in texts]
        made = [" ".join(b.text for b, m in zip(p, keep_block, strict=True) if m) for p, keep_block in zip(parsed, labelled(parsed, network), strict=True)]
        return [made, list(map(len, made))]

    return map_texts(pages, lambda: work, "text string, n_chars long", html, keep)


def html_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
