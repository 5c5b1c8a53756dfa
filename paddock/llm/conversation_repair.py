"""Operator 11, conversation structure repair: the cheapest edits that make the roles of a conversation alternate, by an audit DP over shared prefixes."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fields, kept, prepared

WHITE = " \t\n\v\f\r"
STOPS = ".!?"
USER, ASSISTANT = "user", "assistant"
RIGHT_PAIRS = {"su", "ua", "au"}
#: States of the roles so far: nothing, a system row, ended by a user row, ended by an assistant row
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
REROLE, DELETE, INSERT, STUMP = 1, 2, 5, 5
#: A row's code: its initial (s, u, a, other) and 4 times its fault
FINE, DOOMED, TRUNCATED = 0, 4, 8
_INITIAL = {"s": 0, "u": 1, "a": 2}
#: Where inserted rows lead: state after, how many
_INSERTS = {NOTHING: ((NOTHING, 0), (ASKED, 1), (ANSWERED, 2)), SYSTEM: ((SYSTEM, 0), (ASKED, 1), (ANSWERED, 2)), ASKED: ((ASKED, 0), (ANSWERED, 1)), ANSWERED: ((ANSWERED, 0), (ASKED, 1))}
#: What may happen at a row, with the rows inserted before it: none of them starts another, and their order is that of the audits
TOKENS = sorted("I" * k + edit for k in range(3) for edit in "DKR")
_RANK = {t: r for r, t in enumerate(TOKENS)}
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A7C9E
#: Conversations up to this length are looked up by their codes, so many of them in a worker
MEMO_ROWS, MOST_MEMO = 64, 200_000
#: Rows of a conversation whose texts a task keeps in memory (characters); more wait in its temporary file
SPOOL_CHARS = 8_000_000
#: Prefixes that all live paths share are settled once so many rows are open
SETTLE_ROWS = 8_192
OUT_ROWS, OUT_CHARS = 4_096, 4_000_000
MOST_LONG = (1 << 63) - 1


def _moves(code: int) -> list[list[tuple[int, int, int]]]:
    """For each state after a row: (state before, cost, rank of the token) of all ways to get there."""
    initial, fault = code % 4, code - code % 4
    into: list[list[tuple[int, int, int]]] = [[], [], [], []]
    for before, inserts in _INSERTS.items():
        for state, k in inserts:
            ways = [(state, DELETE, "D")]
            if fault != DOOMED:
                extra, right = (STUMP if fault == TRUNCATED else 0), 2 if state == ASKED else 1
                if initial == 0 and state == NOTHING:
                    ways.append((SYSTEM, extra, "K"))
                ways.append((ANSWERED if right == 2 else ASKED, extra, "K") if initial == right else (ANSWERED if right == 2 else ASKED, extra + REROLE, "R"))
            for after, cost, edit in ways:
                into[after].append((before, cost + INSERT * k, _RANK["I" * k + edit]))
    return into


MOVES = {initial + fault: _moves(initial + fault) for initial in range(4) for fault in (FINE, DOOMED, TRUNCATED)}


class Paths:
    """Edit prefixes as linked nodes: each has its last token, a rolling hash of all its tokens, and ancestors.

    A node at depth d links to its ancestors 2^k above for each 2^k that divides d: two links on average, and any
    ancestor in logarithmic steps. Prefixes that agree share their nodes.
    """

    def __init__(self):
        self.token, self.hash, self.up = [-1], [0], [()]

    def add(self, parent: int, depth: int, token: int) -> int:
        """A node at ``depth`` under ``parent``."""
        up, at, step = [parent], parent, 1
        while depth % (2 * step) == 0:
            at = self.up[at][step.bit_length() - 1]  # the ancestor step above the one that is step above
            up.append(at)
            step *= 2
        self.token.append(token)
        self.hash.append((self.hash[parent] * _BASE + token + 1) % _PRIME)
        self.up.append(tuple(up))
        return len(self.token) - 1

    def first_difference(self, x: int, y: int, depth: int) -> tuple[int, int]:
        """The first nodes where two different paths of one depth part: search for the longest common prefix by hashes.

        The nodes above the two are one node where the hashes told the truth; if not, the paths are compared token by token.
        """
        a, b, d, below = x, y, depth, False
        k = (d & -d).bit_length() - 1
        while k >= 0:
            p, q = self.up[a][k], self.up[b][k]
            if self.hash[p] != self.hash[q]:
                a, b, d = p, q, d - (1 << k)
                k = k - 1 if below else (d & -d).bit_length() - 1
            else:
                k, below = k - 1, True
        if self.up[a][0] == self.up[b][0] and self.token[a] != self.token[b]:
            return a, b
        a, b, found = x, y, (x, y)
        while a != b:
            if self.token[a] != self.token[b]:
                found = a, b
            a, b = self.up[a][0], self.up[b][0]
        return found

    def less(self, x: int, y: int, depth: int) -> bool:
        a, b = self.first_difference(x, y, depth)
        return self.token[a] < self.token[b]

    def tokens(self, node: int, depth: int) -> list[int]:
        out = []
        for _ in range(depth):
            out.append(self.token[node])
            node = self.up[node][0]
        return out[::-1]

    def settled(self, live: list[int | None], depth: int) -> tuple[list[int], list[int | None], int, Paths]:
        """Tokens that all live paths share, and the live nodes, their depth and the nodes of the rest."""
        tips, d = {x for x in live if x is not None}, depth
        while len(tips) > 1:
            tips, d = {self.up[x][0] for x in tips}, d - 1
        trunk = self.tokens(next(iter(tips)), d)
        rest, made = Paths(), {next(iter(tips)): 0}
        levels = [[x for x in live if x is not None]]
        while len(levels) <= depth - d:
            levels.append([self.up[x][0] for x in levels[-1]])
        for level, row in enumerate(reversed(levels[:-1]), 1):
            for x in row:
                if x not in made:
                    made[x] = rest.add(made[self.up[x][0]], level, self.token[x])
        return trunk, [None if x is None else made[x] for x in live], depth - d, rest


def cheapest(codes: bytes) -> tuple[int, list[int], int]:
    """Cost, the rank of each row's token, and how many rows are inserted at the end, of the cheapest and then ASCII-least audit of a conversation."""
    paths, cost, live, depth, done, settle = Paths(), [0, None, None, None], [0, None, None, None], 0, [], SETTLE_ROWS
    for code in codes:
        depth += 1
        new_cost: list[int | None] = [None] * 4
        new: list[int | None] = [None] * 4
        for after, ways in enumerate(MOVES[code]):
            best = None
            for before, price, token in ways:
                if (so_far := cost[before]) is None:
                    continue
                total = so_far + price
                if best is None or total < best[0]:
                    best = total, before, token
                elif total == best[0]:
                    x, y = live[before], live[best[1]]
                    if token < best[2] if x == y else paths.less(x, y, depth - 1):
                        best = total, before, token
            if best is not None:
                new_cost[after], new[after] = best[0], (live[best[1]], best[2])
        _drop_dominated(new_cost)
        live = [None if new_cost[s] is None else paths.add(new[s][0], depth, new[s][1]) for s in range(4)]
        cost = new_cost
        if depth >= settle:
            trunk, live, depth, paths = paths.settled(live, depth)
            done += trunk
            settle = max(SETTLE_ROWS, 2 * depth)
    best = None
    for state, k in ((NOTHING, 0), (ANSWERED, 0), (SYSTEM, 2), (ASKED, 1)):
        if cost[state] is None:
            continue
        total = cost[state] + INSERT * k
        if best is None or total < best[0] or (total == best[0] and paths.less(live[state], live[best[1]], depth)):
            best = total, state, k
    return best[0], done + paths.tokens(live[best[1]], depth), best[2]


def _drop_dominated(cost: list[int | None]) -> None:
    """Forgets states that another one beats whatever follows, so that what all live paths share grows with the rows."""
    answered = min((c + extra for c, extra in ((cost[ANSWERED], 0), (cost[ASKED], INSERT)) if c is not None), default=None)
    if answered is None:
        return
    for state, extra in ((NOTHING, DELETE), (SYSTEM, 0), (ASKED, INSERT)):
        if cost[state] is not None and answered + extra < cost[state] and (state != ASKED or cost[ANSWERED] is not None):
            cost[state] = None


class _Spool:
    """Rows in order; beyond some size they wait in a temporary file of the task, which goes with it."""

    def __init__(self):
        self.rows, self.size, self.file = [], 0, None

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[1]) + len(row[2]) + 64
        if self.size > SPOOL_CHARS:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows


class Conversation:
    """One conversation, fed with its rows in order: its faults, and what repairs it."""

    def __init__(self, key):
        self.key, self.codes, self.spool, self.seen = key, bytearray(), _Spool(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        bare = text.rstrip(WHITE)
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if not bare:
            fault = DOOMED
            self.blank += 1
        elif mark in self.seen:
            fault = DOOMED
            self.duplicate += 1
        elif bare[-1] not in STOPS:
            fault = TRUNCATED
            self.truncated += 1
        else:
            fault = FINE
        self.seen.add(mark)
        initial = role[:1]
        if self.codes and self.initial + initial not in RIGHT_PAIRS:
            self.illegal += 1
        self.initial = initial
        if turn is not None and (self.first is None or turn != self.last):
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        self.codes.append(_INITIAL.get(initial, 3) + fault)
        self.spool.add((turn, role, text))

    def gaps(self) -> int:
        return 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, MOST_LONG)

    def repair(self, memo: dict) -> tuple[int, str, Iterator[tuple[int | None, str, str, str]]]:
        """Cost, audit, and (turn, role, text, edit) of its rows with the inserted and the deleted ones."""
        codes = bytes(self.codes)
        found = memo.get(codes)
        if found is None:
            found = cheapest(codes)
            if len(codes) <= MEMO_ROWS and len(memo) < MOST_MEMO:
                memo[codes] = found
        cost, ranks, trailing = found
        return cost, "".join(TOKENS[r] for r in ranks) + "I" * trailing, self._rows(ranks, trailing)

    def _rows(self, ranks: list[int], trailing: int) -> Iterator[tuple[int | None, str, str, str]]:
        asked = False  # whether an assistant must follow
        for (turn, role, text), rank in zip(self.spool, ranks, strict=True):
            token = TOKENS[rank]
            for _ in range(len(token) - 1):
                yield None, ASSISTANT if asked else USER, "", "I"
                asked = not asked
            edit = token[-1]
            if edit == "R":
                role = ASSISTANT if asked else USER
            if edit != "D":
                asked = role[:1] == "u"
            yield turn, role, text, edit
        for _ in range(trailing):
            yield None, ASSISTANT if asked else USER, "", "I"
            asked = not asked


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) of every row with the planted damage, chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (no copies), 1 empties its text, 2 takes its full stops and the like, 3 repeats it (two copies), 4 makes it
    a user's. Nulls count as one space in the hash, and as role and text.
    """
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(as_text(conv_id), F.lit(":"), as_text(turn))) % 20
    body = F.when(dealt == 1, "").when(dealt == 2, F.translate(as_text(text), STOPS, "")).otherwise(as_text(text))
    return conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.when(dealt == 4, USER).otherwise(as_text(role)).alias("role"), body.alias("text"),
        F.when(dealt == 0, 0).when(dealt == 3, 2).otherwise(1).alias("copies"),
    )


def whole(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as ``damaged`` gives them, without damage: for conversations that are to be repaired as they are."""
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    key: Column = F.col(f"`{conv_id}`").alias("conv_id")
    return conversations.select(key, F.col(f"`{turn}`").cast("long").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), F.lit(1).alias("copies"))


def _by_conversation(rows: DataFrame, ddl: str, emit) -> DataFrame:
    """``emit(conversation, memo)`` yields rows of ``ddl`` for every conversation. Its rows meet in one task, sorted by the shuffle, and pass by one at a time."""
    schema = T.StructType([rows.schema["conv_id"], *fields(ddl)])
    arrow = to_arrow_schema(schema)
    placed = rows.select("conv_id", "turn", "role", "text", "copies").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
        now = None
        for batch in batches:
            for key, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        yield now
                    now = Conversation(key)
                for _ in range(copies):
                    now.add(turn, role, text)
        if now is not None:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = prepared(lambda: kept("audits", dict))
        out, size = [], 0
        for conversation in conversations(batches):
            for row in emit(conversation, memo):
                out.append((conversation.key, *row))
                size += sum(len(v) for v in row if isinstance(v, str))
                if len(out) >= OUT_ROWS or size > OUT_CHARS:
                    yield _batch(out, arrow)
                    out, size = [], 0
        if out:
            yield _batch(out, arrow)

    return placed.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit) of every repaired conversation: ``edit`` is K for a row kept, R for one with a new role, I for one inserted (without turn).

    Takes what ``damaged`` or ``whole`` gives; deleted rows don't appear.
    """

    def emit(conversation: Conversation, memo: dict):
        stay = (r for r in conversation.repair(memo)[2] if r[3] != "D")
        return ((position, *row) for position, row in enumerate(stay))

    return _by_conversation(rows, "position long, turn long, role string, text string, edit string", emit)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and the letters of its cheapest edits, and SHA-256 of what they leave.

    Takes what ``damaged`` or ``whole`` gives. A conversation is taken by turn, nulls first; rows of one turn by role, then text. A
    row's first fault counts: blank, duplicate (role and text seen before), truncated. Keeping costs nothing, another role 1, deleting 2
    (a must for blank and duplicate rows), inserting 5, and 5 more for a truncated row that stays; what stays reads ``(s?(ua)+)?`` in initials.
    Of equally cheap audits the ASCII-least one counts. Null ids are one conversation; conversations without a row left have zeros and an
    empty audit; an empty table gives no rows. Repeated rows are duplicates. Other columns, of any name, aren't looked at.

    A conversation's rows are streamed: what a task keeps of a row is 16 bytes of hash, one byte for the
    DP, and its text, which waits in a file if there are many. All rows of one conversation meet in one task, as SHA-256 must read them in order.
    """

    def emit(conversation: Conversation, memo: dict):
        cost, audit, rows = conversation.repair(memo)
        digest, first = hashlib.sha256(), True
        for _, role, text, edit in rows:
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        c = conversation
        yield c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, audit, digest.hexdigest()

    return _by_conversation(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", emit)
