"""Text blocks of a web page with the tags above them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: A quote opens a value only behind an equals sign; elsewhere it is part of a name or value, and the next ``>`` ends the tag
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|$)|<[!?/][^>]*(?:>|$)|(?P<text>[^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
#: Tags of the HTML standard whose text is never shown, void tags, and tags inside a line (fixed values)
SILENT = frozenset("script style template noscript textarea select option title svg math iframe object audio video canvas datalist head button".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag of the second kind ends an open element of the first
_ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_SCOPE = frozenset("ul ol dl table article section div body nav aside".split())


class Element:
    """An open element: its names (the tag, then its marks: ".mark") and the one that holds it."""

    __slots__ = ("names", "parent", "known")

    def __init__(self, names: tuple[str, ...], parent: Element | None):
        self.names, self.parent, self.known = names, parent, None

    def path(self) -> tuple[str, ...]:
        """Names of all elements from the root down to this one."""
        found, at = [], self
        while at is not None:
            found.append(at.names)
            at = at.parent
        return tuple(x for names in reversed(found) for x in names)


def element(path: tuple[str, ...]) -> Element | None:
    """Elements one in another with these names."""
    at = None
    for name in path:
        at = Element((name,), at)
    return at


@dataclass(slots=True)
class Block:
    text: str
    inside: Element | None
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        return self.inside.path() if self.inside else ()


def blocks(html: str) -> list[Block]:
    """The page's blocks in order: runs of text between the edges of block elements, white space folded. Time and memory grow with the page, however deep it is nested."""
    stack: list[tuple[str, Element]] = []
    opened: Counter = Counter()
    out: list[Block] = []
    parts: list[str] = []
    inside: Element | None = None
    linked = silent = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, inside, linked))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal silent
        while len(stack) > depth:
            tag, _ = stack.pop()
            opened[tag] -= 1
            silent -= tag in SILENT

    at, size = 0, len(html)
    while at < size:
        token = _TOKEN.match(html, at)
        if token is None:  # cannot be: every character starts some token
            break
        at = token.end()
        if (text := token["text"]) is not None:
            if not silent:
                if not parts:
                    inside = stack[-1][1] if stack else None
                text = unescape(text) if "&" in text else text
                parts.append(text)
                if opened["a"]:
                    linked += len(text)
            continue
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["close"]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ") if tag == "br" else flush()
            continue
        if tag not in INLINE:
            flush()
            if any(opened[t] for t in _ENDS):
                for i in range(len(stack) - 1, -1, -1):
                    if tag in _ENDS.get(stack[i][0], ()):
                        pop_to(i)
                        break
                    if stack[i][0] in _SCOPE:
                        break
        rest = token["rest"]
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        marks = []
        if rest:
            for name, *values in _ATTRIBUTE.findall(rest):
                marks += ["." + m for v in values for m in _NAME.findall(v.lower())] or (["." + name.lower()] if name.lower() == "hidden" else [])
        stack.append((tag, Element((tag, *dict.fromkeys(marks)), stack[-1][1] if stack else None)))
        opened[tag] += 1
        silent += tag in SILENT
    flush()
    return out
