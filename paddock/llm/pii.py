"""Operator 6, PII: pseudonyms by keyed Feistel permutations that keep each value's format."""

from __future__ import annotations

import calendar
import datetime
import hashlib
import ipaddress
import re
import secrets
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date", "secret")
ROUNDS = 8
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: First and last years within which dates are permuted
_ERAS = ((1, 1899), (1900, 2099), (2100, 9999))
#: Lengths of IBANs by country (fixed values)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Forms of personal data (fixed values); each find is validated before it is changed
_SECRET_HEADS = r"(?:AKIA|ASIA)(?=[A-Z0-9]{16}(?!\w))|gh[pousr]_(?=[A-Za-z0-9]{20})|github_pat_(?=\w{20})|[spr]k_(?:live|test)_(?=[A-Za-z0-9]{10})|sk-(?=[\w-]{20})|xox[abprs]-(?=[A-Za-z0-9-]{10})|AIza(?=[\w-]{35})|eyJ(?=[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
_SECRET_KEYS = r"(?i:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s?[=:]\s?[\"']?"
_SECRET = re.compile(
    rf"(?P<head>(?<!\w)(?:{_SECRET_HEADS}))(?P<body>[\w.-]+)"
    r"|(?P<bearer>(?<!\w)(?i:bearer)\s+)(?P<shown>[A-Za-z0-9._~+/-]{16,}=*)"
    rf"|(?P<key>(?<![A-Za-z0-9]){_SECRET_KEYS})(?P<given>[^\s\"',;<>()]+)"
    r"|(?P<begin>-----BEGIN [A-Z ]*PRIVATE KEY-----)(?P<block>[A-Za-z0-9+/=\s]+)"
)
_DATES = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
_FORMS = {
    "email": r"(?<![\w.+-])[^\W_][\w.%+-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}",
    "secret": re.sub(r"\?P<\w+>", "?:", _SECRET.pattern),
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)|(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)",
    "date": rf"(?<![\w/.-])(?:{_DATES})(?!(?!T\d\d:\d\d)\w|[/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\w)|(?<!\w)(?i:ssn|social security(?: number)?)[:# ]{1,3}\d{3} \d{2} \d{4}(?![\w-])",
    "card": r"(?<![\w+-])\d(?:[ -]?\d){12,}(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w|-\d)|(?<!\w)\+\d{1,3}(?:[ .-]\d{2,4}){2,6}(?!\w)|(?<!\w)\+[1-9]\d{7,14}(?!\w)"
    r"|(?<![\w.+-])1(?P<first>[ .-])[2-9]\d\d(?P=first)[2-9]\d\d(?P=first)\d{4}(?!\w|[.-]\d)|(?<![\w.+-])00[1-9]\d{0,2}(?:[ .-]\d{2,8}){2,6}(?!\w|[.-]\d)|(?<![\w.+-])00[1-9]\d{7,14}(?!\w|[.-]\d)"
    r"|(?<![\w.+-])[2-9]\d\d(?P<mark>[ .-])[2-9]\d\d(?P=mark)\d{4}(?!\w|[.-]\d)|(?<![\w.+-])0[1-9](?:\d{8,9}|(?:[ .-]\d\d){4})(?!\w|[.-]\d)",
}
PATTERN, _NO_CARD = (re.compile("|".join(f"(?P<{k}>{f})" for k, f in _FORMS.items() if k != without)) for without in ("", "card"))
#: Forms that end a run of digits in which a card is looked for: they are exchanged by themselves
_OWN = re.compile(rf"\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\w|\.\d)|(?:{_DATES}|\d{{3}}-\d{{2}}-\d{{4}})(?!(?!T\d\d:\d\d)\w|[/-]|\.\d)")
_GROUP = re.compile(r"(?<=[ -])\d")
#: What stands before four numbers that are a version or a section, not an address
_VERSION = re.compile(r"(?i)(?<!\w)(?:version|ver|v|release|revision|rev|build|section|chapter|firmware)[.:]?\s?\Z")
#: Every form has one of these characters, or is a key's block
_MARKS = re.compile(r"[0-9@=:]|bearer|-----BEGIN|eyJ|gh[pousr]_|github_pat_", re.I)


class Cipher:
    """Permutations of whole-number ranges, fixed by a secret key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: bytes, i: int, x: int, size: int) -> int:
        digest = hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 + 1, "big"), key=self.key, person=(tag + b"%d" % i)[:16], digest_size=64).digest()
        return int.from_bytes(digest, "big") % size

    def permute(self, value: int, size: int, tag: bytes, back: bool = False) -> int:
        """Another number below ``size`` (its inverse with ``back``): a Feistel network over a slightly larger square, walked until the result is in range."""
        side = max(2, int(size**0.5) if size < 1 << 50 else 1 << (size.bit_length() + 1) // 2)
        while side * side < size:
            side += 1
        while True:
            left, right = divmod(value, side)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = (right - self._round(tag, i, left, side)) % side, left
                else:
                    left, right = right, (left + self._round(tag, i, right, side)) % side
            value = left * side + right
            if value < size:
                return value

    def characters(self, text: str, tag: bytes, back: bool = False, sets: tuple[str, ...] = (_LOWER, _UPPER, _DIGITS)) -> str:
        """Letters and digits exchanged for others of their set; case, length and all other characters stay.

        A Feistel network on the halves of the text, of any length: each round moves every character of one half
        by a keyed stream, as long as that half, of the whole other half.
        """
        chosen = [(i, c) for i, x in enumerate(text) for c in sets if x in c]
        if len(chosen) < 2:
            return "".join(c[self.permute(c.index(x), len(c), tag, back)] if (c := next((c for c in sets if x in c), "")) else x for x in text)
        size = [len(c) for _, c in chosen]
        now = [c.index(text[i]) for i, c in chosen]
        middle, out = len(now) // 2, list(text)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            mine, other = (slice(0, middle), slice(middle, None)) if r % 2 else (slice(middle, None), slice(0, middle))
            n = len(now[mine])
            stream = hashlib.shake_256(b"%s|%s|%d|%d|" % (self.key, tag, len(now), r) + bytes(now[other])).digest(8 * n)
            moves = (int.from_bytes(stream[8 * k : 8 * k + 8], "big") for k in range(n))
            now[mine] = [(x - m if back else x + m) % s for x, m, s in zip(now[mine], moves, size[mine], strict=True)]
        for (i, c), x in zip(chosen, now, strict=True):
            out[i] = c[x]
        return "".join(out)

    def digits(self, digits: str, lowest: str, tag: bytes, back: bool = False) -> str:
        """Digits exchanged as one number; each is at least that of ``lowest`` at its place, as it was before."""
        value, size, out = 0, 1, []
        for d, low in zip(digits, map(int, lowest), strict=True):
            value, size = value * (10 - low) + int(d) - low, size * (10 - low)
        value = self.permute(value, size, tag, back)
        for low in map(int, reversed(lowest)):
            value, d = divmod(value, 10 - low)
            out.append(str(d + low))
        return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _put(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in _DIGITS else c for c in form)


def _email(text: str, c: Cipher, back: bool) -> str | None:
    body, _, top = text.rpartition(".")
    return f"{c.characters(body, b'email', back)}.{top}"


def _secret(text: str, c: Cipher, back: bool) -> str | None:
    m = _SECRET.fullmatch(text)
    head = m["head"] or m["bearer"] or m["key"] or m["begin"]
    body = text[len(head) :]
    # prose or code may follow a key: after "password:" without quotes only what has a digit or capitals inside counts, and short words and numbers never do
    if m["key"] and "=" not in head and head[-1] not in "\"'" and not re.search(r"\d|[^A-Z\W_][A-Z]", body):
        return None
    if m["key"] and len(body) < 8 and not (re.search(r"[A-Za-z]", body) and re.search(r"\d", body)):
        return None
    return head + c.characters(body, b"secret", back)


def _iban_check(plain: str) -> int:
    return int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN at ``start`` ends, at ``end`` at most: at its country's length, for unknown countries at the first word end with right check digits. None if it isn't one."""
    plain, length = "", IBAN_LENGTHS.get(text[start : start + 2])
    for i in range(start, end):
        if text[i] == " ":
            continue
        plain += text[i]
        whole = not (text[i + 1 : i + 2].isalnum() or text[i + 1 : i + 2] == "_")
        if (len(plain) == length if length else len(plain) >= 15) and whole and _iban_check(plain) == 1:
            return i + 1
        if len(plain) == length:
            return None
    return None


def _iban(text: str, c: Cipher, back: bool) -> str | None:
    plain = text.replace(" ", "")
    while True:  # of an unknown country until no earlier end would do, so that it is found again
        body = c.characters(plain[4:], b"iban", back)
        plain = plain[:2] + f"{98 - _iban_check(plain[:2] + '00' + body):02d}" + body
        new = iter(plain)
        made = "".join(x if x == " " else next(new) for x in text)
        if _iban_end(made, 0, len(made)) == len(made):
            return made


def _ip(text: str, c: Cipher, back: bool) -> str | None:
    if ":" in text:
        groups = [g for g in text.split(":") if g]
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        if len(groups) < 3 and (len(groups) < 2 or max(map(len, groups)) < 4) or not any(x in _DIGITS for x in text):
            return None
        small = lambda x: any(y in _LOWER for y in x) or not any(y in _UPPER for y in x)
        sets, new = ("0123456789abcdef", "ABCDEF") if small(text) else ("0123456789ABCDEF",), text
        while True:
            new = c.characters(new, b"ipv6", back, sets)
            if any(x in _DIGITS for x in new) and small(new) == small(text):
                return new
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = c.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, c: Cipher, back: bool) -> str | None:
    parts, mark = [int(x) for x in re.split(r"\D", text)], re.search(r"\D", text)[0]
    order = "ymd" if text[4:5] == mark else "mdy" if mark != "." and parts[0] <= 12 else "dmy"
    at = dict(zip(order, parts, strict=True))
    try:
        day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
    except ValueError:
        return None
    first, last = next(era for era in _ERAS if era[0] <= at["y"] <= era[1])
    if order != "ymd" and mark != ".":
        # the day stays, since days over 12 tell which of the two readings holds; year and month are permuted
        month = (at["y"] - first) * 12 + at["m"] - 1
        while True:
            month = c.permute(month, 12 * (last - first + 1), b"month", back)
            at |= {"y": first + month // 12, "m": month % 12 + 1}
            if at["d"] <= calendar.monthrange(at["y"], at["m"])[1]:
                break
    else:
        low, high = datetime.date(first, 1, 1).toordinal(), datetime.date(last, 12, 31).toordinal()
        new = datetime.date.fromordinal(low + c.permute(day - low, high - low + 1, b"date", back))
        at = {"y": new.year, "m": new.month, "d": new.day}
    bare = re.search(r"(?<!\d)\d(?!\d)", text) is not None  # written without leading zeros
    return mark.join(f"{at[k]:04d}" if k == "y" else str(at[k]) if bare else f"{at[k]:02d}" for k in order)


def _ssn(text: str, c: Cipher, back: bool) -> str | None:
    area, group, serial = map(int, re.findall(r"\d+", text))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    value = c.permute((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn", back)
    (rank, group), serial = divmod(value // 9999, 99), value % 9999
    return _put(text, f"{rank + 1 + (rank >= 665):03d}{group + 1:02d}{serial + 1:04d}")


#: A card's digits stand together, in fours, or as 4, 6 and 4 or 5
_CARD_FORM = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}[ -]\d{1,4}|\d{4}[ -]\d{6}[ -]\d{4,5}")


def _valid_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return _CARD_FORM.fullmatch(text) is not None and 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and digits.strip("0") != ""


def _first_card(run: str) -> tuple[int, int] | None:
    """(start, end) of the card that ends first in a run of digit groups. It depends on no digit after its end, which may be exchanged too."""
    starts: list[int] = []
    for m in re.finditer(r"\d+", run):
        if run[m.start() - 1 : m.start()] != "-":
            starts = [x for x in starts if m.start() - x < 40] + [m.start()]
        if run[m.end() : m.end() + 1] != "-":
            for start in starts:
                if _valid_card(run[start : m.end()]):
                    return start, m.end()
    return None


def _card(run: str, at: tuple[int, int], c: Cipher, back: bool) -> str:
    """The run up to the card's end, the card exchanged: permuted until it is again the first card of the run, so that it is found again."""
    text, before = run[at[0] : at[1]], run[: at[0]]
    near = before if len(before) < 40 else before[-40:].lstrip("0123456789-")
    place = len(near), len(near) + len(text)
    while True:
        digits = re.sub(r"\D", "", text)
        # issuers' numbers start with 1 to 9: so does the pseudonym where the number does
        lead = digits[0] != "0"
        size = 10 ** (len(digits) - 1)
        low = size // 10 if lead else 0
        value = low + c.permute(int(digits[:-1]) - low, size - low if lead else size // 10, b"card%d" % len(digits), back)
        body = f"{value:0{len(digits) - 1}d}"
        text = _put(text, body + luhn_digit(body))
        if _first_card(near + text) == place:
            return before + text


def _phone_end(text: str) -> int:
    """Where a phone number in international form ends: a run of groups with over 15 digits holds another number as well, and goes on after at most 13 of them."""
    abroad = 2 if text.startswith("00") else 0
    if (text[0] == "+" or abroad) and "(" not in text and sum(x in _DIGITS for x in text) > 15 + abroad:
        ends = [m.end() for m in re.finditer(r"\d+", text)]
        return max((e for e in ends if sum(x in _DIGITS for x in text[:e]) <= 13 + abroad), default=0)
    return len(text)


def _phone(text: str, c: Cipher, back: bool) -> str | None:
    """Country codes, the first digit of compact numbers and a leading 0 stay; area codes and exchanges that start with 2 to 9 still do."""
    head = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|00[1-9]\d{0,2}(?=[ .-])|00[1-9]|0|1(?=[ .-])|", text)[0]
    digits = re.sub(r"\D", "", text[len(head) :])
    if not 8 <= len(digits) + sum(x in _DIGITS for x in head) - 2 * head.startswith("00") <= 15:
        return None
    plain = head in ("", "1") and text[0] != "("
    lowest = "".join("2" if plain and i in (0, 3) else "1" if head == "0" and not i else "0" for i in range(len(digits)))
    return head + _put(text[len(head) :], c.digits(digits, lowest, b"phone%d" % len(digits), back))


_CHANGE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


class Pseudonyms:
    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS):
        self.cipher, self.kinds = Cipher(key), frozenset(kinds)

    def text(self, text: str, back: bool = False) -> tuple[str, Counter]:
        """The text with its values of the chosen kinds exchanged, and how many of each kind."""
        found: Counter = Counter()
        if not _MARKS.search(text):
            return text, found

        out, done, at, end, stop, refused = [], 0, 0, -1, -1, -1
        while True:
            match = (_NO_CARD if at < refused else PATTERN).search(text, at)
            if match and at < refused <= match.start():
                at = refused
                continue
            if not match:
                break
            kind, at = next(k for k, v in match.groupdict().items() if v is not None and k in KINDS), match.end()
            new = None
            if kind == "card":
                # a run ends before an address or a date, which is searched by itself as what follows a card is
                if at != end or stop <= match.start():
                    end = at
                    stop = next((m.start() - 1 for m in _GROUP.finditer(text, match.start() + 1, end) if _OWN.match(text, m.start())), end)
                run = text[match.start() : stop]
                place = _first_card(run)
                if place:
                    at = match.start() + place[1]
                    new = _card(run, place, self.cipher, back) if kind in self.kinds else None
                else:  # its groups may be other numbers
                    at, refused = match.start(), stop
            else:
                value = match[0]
                if kind == "iban":
                    stop_at = _iban_end(text, match.start(), match.end())
                    value, at = text[match.start() : stop_at] if stop_at else "", stop_at or match.start() + 4
                if kind == "phone":
                    value = value[: _phone_end(value)]
                    at = match.start() + max(1, len(value))
                known = kind in self.kinds and value and not (kind == "ip" and _VERSION.search(text, max(0, match.start() - 12), match.start()))
                new = _CHANGE[kind](value, self.cipher, back) if known else None
            if new is not None:
                found[kind] += 1
                out += text[done : match.start()], new
                done = at
        return "".join(out) + text[done:], found


def session_key(spark: SparkSession) -> bytes:
    """The key of ``spark.paddock.pii.key``; a session without one gets a random key, so that nobody can restore what it writes."""
    given = spark.conf.get("spark.paddock.pii.key", None)
    return given.encode() if given else secrets.token_bytes(32)


def pseudonymize(docs: DataFrame, key: bytes, kinds: tuple[str, ...] = KINDS, text: str = "text", keep: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """Every row with ``text`` rewritten, ``n_pii`` and a count ``n_<kind>`` of each kind.

    A value is validated first: card numbers by their check digit, IBANs by theirs, addresses by
    their ranges and what stands before them, dates by the calendar, phone numbers by their form (a country code, an area code in
    brackets, the North American plan or a leading 0). A run of digit groups that forms a card only once its other numbers are exchanged isn't restored. One key gives equal values equal pseudonyms in all
    documents; with the key, ``back`` restores the text. Null and empty texts become empty.
    """

    def make():
        pseudonyms = Pseudonyms(key, kinds)

        def work(texts):
            made = [pseudonyms.text(t, back) for t in texts]
            return [[t for t, _ in made], [sum(n.values()) for _, n in made], *([n[k] for _, n in made] for k in KINDS)]

        return work

    return map_texts(docs, make, "text string, n_pii long, " + ", ".join(f"n_{k} long" for k in KINDS), text, keep)
