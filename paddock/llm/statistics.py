"""Statistics of a text for the quality operators, counted over its whole length."""

from __future__ import annotations

import numpy as np

WORD_SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the tree models read. Shares are of characters in words, of words or of lines.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share",
    "pipe_share", "stop_share", "comma_share", "distinct_share", "twin_share", "long_word_share", "one_char_share",
    "line_words", "non_ascii_share", "other_share", "quote_share", "bracket_share",
)
WINDOW = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words that lie in windows of five which occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = hashes[:n] * _MIX[0]
    for k in range(1, WINDOW):
        mixed += hashes[k : n + k] * _MIX[k]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # equal windows have equal hashes; the words themselves decide
    found: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(mixed, twice)).tolist():
        found.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for at in found.values():
        if len(at) > 1:
            np.add.at(edges, at, 1)
            np.add.at(edges, np.array(at) + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines that hold a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(BASE counts as int64, FEATURES as float64), a row for each text."""
    base, shares = np.zeros((len(texts), len(BASE)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        raw = text.encode()
        words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
        n = len(words)
        if not n:
            continue
        count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        chars = len(text) - int(count[9:14].sum() + count[32])
        symbols = int(count[list(SYMBOLS)].sum())
        lines, copies = repeated_lines(text)
        repeats = repeated_words(words, hashes)
        base[row] = n, chars, symbols, copies, repeats
        ascii_letters = int(count[65:91].sum() + count[97:123].sum())
        known = ascii_letters + int(count[48:58].sum()) + int(count[list(b".,!?;:'\"-()")].sum()) + symbols
        non_ascii = len(text) - int(count[:128].sum())
        shares[row] = (
            np.log1p(n), chars / n, symbols / chars, copies / max(lines, 1), repeats / n, count[65:91].sum() / chars,
            count[48:58].sum() / chars, count[33] / n, count[124] / n, count[46] / n, count[44] / n,
            len(np.unique(hashes)) / n, (hashes[1:] == hashes[:-1]).sum() / n, (lengths > 24).sum() / n, (lengths == 1).sum() / n,
            np.log1p(n / max(lines, 1)), non_ascii / chars, max(0, chars - known - non_ascii) / chars, count[34] / n, count[list(b"()[]{}")].sum() / n,
        )
    return base, shares
