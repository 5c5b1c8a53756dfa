"""Conversation repair against full strings of edits, and its query against a plain loop over all rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from paddock.llm import conversation_repair as repair
from paddock.llm.common import table

WHITE = " \t\n\v\f\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def _after(state: str, initial: str) -> str | None:
    """The state of the roles after one more: what they end on."""
    return {"s": "s" if state == "" else None, "u": "u" if state != "u" else None, "a": "a" if state == "u" else None}.get(initial)


def _insertions(best: dict) -> dict:
    todo = list(best)
    while todo:
        state = todo.pop()
        for initial in "ua":
            after = _after(state, initial)
            made = (best[state][0] + 5, best[state][1] + "I")
            if after is not None and (after not in best or made < best[after]):
                best[after] = made
                todo.append(after)
    return best


def _plain(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cheapest cost and least audit of (initial, fault) rows, with whole strings kept for each state."""
    best = {"": (0, "")}
    for initial, fault in rows:
        best, new = _insertions(best), {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 2, audit + "D")]
            if fault not in ("blank", "duplicate"):
                stay = cost + 5 * (fault == "truncated")
                ways += [(_after(state, initial), stay, audit + "K")] + [(_after(state, i), stay + 1, audit + "R") for i in "ua"]
            for after, total, letters in ways:
                if after is not None and (after not in new or (total, letters) < new[after]):
                    new[after] = (total, letters)
        best = new
    return min(v for k, v in _insertions(best).items() if k in ("", "a"))


def _expected(rows: list[tuple]) -> dict:
    """The query's rows from (conv_id, turn, role, text) by a plain loop."""
    found = defaultdict(list)
    space = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        role, text, h = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        found[conv] += []
        if h == 0:
            continue
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        found[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, lines in found.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in lines:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in lines if t is not None]
        cost, audit = _plain([(r[:1], f) for (_, r, _), f in zip(lines, faults, strict=True)])
        state, kept, queue = "", [], list(lines)
        for letter in audit:
            follows = "assistant" if state == "u" else "user"
            if letter == "I":
                kept.append(f"{follows}:")
                state = follows[0]
                continue
            _, role, text = queue.pop(0)
            if letter != "D":
                kept.append(f"{follows if letter == 'R' else role}:{text}")
                state = kept[-1][0]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def _rows(df) -> dict:
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("settle", [1, 3, 8192])
def test_audits_equal_whole_strings(monkeypatch, settle):
    monkeypatch.setattr(repair, "SETTLE_ROWS", settle)
    rng, codes = random.Random(settle), sorted(repair.MOVES)
    for _ in range(1500):
        some = rng.choice([codes, [0, 1, 2, 3], [3], [0, 3, 11], [1, 2, 9, 10, 4]])
        row = bytes(rng.choice(some) for _ in range(rng.randint(0, 16)))
        cost, ranks, trailing = repair.cheapest(row)
        audit = "".join(repair.TOKENS[r] for r in ranks) + "I" * trailing
        assert (cost, audit) == _plain([("suax"[c % 4], {0: "", 4: "blank", 8: "truncated"}[c - c % 4]) for c in row])


def test_collisions_are_verified(monkeypatch):
    rows = [bytes(random.Random(k).choice([0, 1, 2, 3, 4, 11]) for _ in range(60)) for k in range(200)]
    right = [repair.cheapest(r) for r in rows]
    monkeypatch.setattr(repair, "_PRIME", 3)  # nearly all hashes agree
    assert [repair.cheapest(r) for r in rows] == right


def test_tracks_that_never_meet_take_logarithmic_steps():
    """All rows need a new role: two equally cheap ways run beside each other to the end."""
    cost, ranks, trailing = repair.cheapest(bytes([3]) * 50_001)
    assert (cost, trailing, repair.TOKENS[ranks[0]]) == (50_002, 0, "D")


def test_query_equals_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    given = table(spark, sf, "conversations")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert _rows(repair.audits(repair.damaged(given))) == _expected(rows)


def test_many_texts_wait_in_a_file(monkeypatch):
    monkeypatch.setattr(repair, "SPOOL_CHARS", 500)
    spool, rows = repair._Spool(), [(k, "user", "x" * (k % 70)) for k in range(100)]
    for row in rows:
        spool.add(row)
    assert spool.file is not None and len(spool.rows) < 10 and list(spool) == rows == list(spool)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(120)]:
        for _ in range(rng.randint(1, 12)):
            role = rng.choice(["system", "user", "assistant", "", None, "User", "tool"])
            rows.append((conv, rng.choice([None, *range(6), -4, 2**62]), role, rng.choice([None, "", " ", "yes.", "no", "Why?\n", "x" * 300 + "!"])))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.selectExpr("text", "role as role", "'a' as copies", "1 as audit", "conv_id", "turn", "0L as position", "'b' as `x.y`")
    assert _rows(repair.audits(repair.damaged(wide))) == _expected(rows)


def test_rows_and_audits_tell_the_same(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = repair.damaged(df)
    texts = defaultdict(list)
    for r in repair.repaired(rows).orderBy("conv_id", "position").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.position == len(texts[r.conv_id]) - 1
    for conv, row in _rows(repair.audits(rows)).items():
        assert hashlib.sha256("\n".join(texts[conv]).encode()).hexdigest() == row[-1]


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair.audits(repair.damaged(none)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:7".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 7, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert _rows(repair.audits(repair.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert repair.repaired(repair.damaged(df)).count() == 0


def test_extreme_turns(spark):
    df = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    assert _rows(repair.audits(repair.whole(df)))[1][0] == 2**63 - 1
