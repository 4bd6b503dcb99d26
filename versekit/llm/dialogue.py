"""Conversation structure repair: the cheapest edits that give a conversation its order of turns.

A conversation's rows, in order, must become roles whose initials match
``(s?(ua)+)?``.  Every row is kept (0), given the role user or assistant (2) or
deleted (3; a must for blank and repeated rows); empty user and assistant rows
may be inserted anywhere (2); a truncated row that stays costs 1 more.  The
nodes of the edit lattice are (rows read, state of the pattern).  Two heaps, one
from the start and one from the end, settle nodes until their smallest costs
sum to more than the best crossing, so that all crossings of least cost are
seen; of these the least audit (initials of the edits: K, R, D, I) is taken.

An audit names its path, as a state allows one role only to be given or
inserted; so no audit of least cost to a node begins with another, and the
least audit is made of least parts.  Hence longer conversations are solved in
stretches of ``STRETCH`` rows, for every pair of states at their ends, and the
stretches joined from the last to the first.

Rows are dealt by conversation and sorted there, then read as a stream: a task
holds one byte for each row of a conversation, 16 bytes for each text it compares
with, and a stretch's heaps; texts wait in a file of the task's own, which ends
with the conversation, until they are hashed.  One conversation is read by one
task, as its audit is one value and its hash runs over its rows in order.

Defined results: nulls in role and text are one space, a null conversation id is
a conversation of its own, null turns come first, equal turns are ordered by
role and text, repeated rows count each; a role without an allowed initial cannot
be kept; an empty table gives no rows; texts of any length are read whole;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 1024
#: Bytes of a conversation's texts that a task holds before they go to its file.
HELD_BYTES = 8 << 20

#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a state goes with a role's initial, and the role that is given or inserted there.
STEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ENDS = (START, ASSISTANT)
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}

SPACE = " \t\n\x0b\x0c\r"


def sign(initial: str, fault: str) -> str:
    """A row as one character for the lattice: its role's initial (x if none can be kept), a capital if it is truncated, - if it must go."""
    known = initial if initial in ("s", "u", "a") else "x"
    return "-" if fault in ("blank", "duplicate") else known.upper() if fault == "truncated" else known


def edits(row: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) that read a row."""
    out = [("D", DELETE, state)]
    if row != "-":
        cut = CUT * row.isupper()
        if row.lower() in STEP[state]:
            out.append(("K", cut, STEP[state][row.lower()]))
        out.append(("R", RENAME + cut, STEP[state][NEXT[state]]))
    return out


def search(rows: str, entry: int, exits: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """(cost, least audit) from the state before the rows to one of the states behind them.

    Rows may be inserted before each row, and after the last one if nothing follows.
    """
    n = len(rows)

    def out(i: int, q: int) -> list[tuple[str, int, int, int]]:
        found = [(e, c, i + 1, t) for e, c, t in edits(rows[i], q)] if i < n else []
        return found + ([("I", INSERT, i, STEP[q][NEXT[q]])] if i < n or last else [])

    def into(i: int, q: int) -> list[tuple[str, int, int, int]]:
        found = [(e, c, i - 1, p) for p in STEP for e, c, t in edits(rows[i - 1], p) if t == q] if i else []
        return found + ([("I", INSERT, i, p) for p in STEP if STEP[p][NEXT[p]] == q] if i < n or last else [])

    # edges that cost nothing read a row, so among equal costs the nearer end goes first and labels are final when taken
    heaps = ([(0, 0, "", entry)], sorted((0, 0, "", q) for q in exits))
    done: tuple[dict, dict] = ({}, {})
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        back = heaps[1][0][0] < heaps[0][0][0]
        cost, far, audit, q = heapq.heappop(heaps[back])
        i = n - far if back else far
        own, other = done[back], done[not back]
        if (i, q) in own:
            continue
        own[i, q] = (cost, audit)
        ways = [("", 0, i, q), *(into if back else out)(i, q)]
        for e, c, j, t in ways:
            a = e + audit if back else audit + e
            if (j, t) in other:  # a crossing: both labels are settled
                oc, oa = other[j, t]
                whole = (cost + c + oc, a + oa if not back else oa + a)
                best = whole if best is None else min(best, whole)
            if (j, t) not in own:
                heapq.heappush(heaps[back], (cost + c, n - j if back else j, a, t))
    return best


@lru_cache(maxsize=1 << 16)
def _short(rows: str) -> tuple[int, str]:
    return search(rows, START, ENDS, True)


def repair(rows: str, stretch: int = STRETCH) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation's rows (``sign`` of each)."""
    if len(rows) <= min(stretch, 64):
        return _short(rows)
    *starts, last = range(0, len(rows), stretch)
    ends = {q: search(rows[last:], q, ENDS, True) for q in STEP}
    costs, ways = {q: c for q, (c, _) in ends.items()}, []
    for at in reversed(starts):
        way = {}
        for q in STEP:
            found = [(w[0] + costs[t], w[1], t) for t in costs if (w := search(rows[at:at + stretch], q, (t,), False))]
            way[q] = min(found)  # deleting every row leads from a state to itself at least
        ways.append(way)
        costs = {q: w[0] for q, w in way.items()}
    audit, q = [], START
    for way in reversed(ways):
        audit.append(way[q][1])
        q = way[q][2]
    return costs[START], "".join([*audit, ends[q][1]])


class Seen:
    """Digests met before: a set of recent ones and sorted arrays, of 16 bytes each, of the others."""

    def __init__(self, held: int = 1 << 17):
        self.recent: set[bytes] = set()
        self.runs: list[np.ndarray] = []
        self.held = held

    def again(self, digest: bytes) -> bool:
        """Whether the digest was met; it is from now on."""
        if digest in self.recent:
            return True
        x = np.frombuffer(digest, ">u8").astype(np.uint64).view("u8,u8")[0] if self.runs else None
        for run in self.runs:
            i = int(np.searchsorted(run, x))
            if i < len(run) and run[i] == x:
                return True
        self.recent.add(digest)
        if len(self.recent) >= self.held:
            new = np.sort(np.frombuffer(b"".join(self.recent), ">u8").astype(np.uint64).view("u8,u8"))
            self.recent.clear()
            while self.runs and len(self.runs[-1]) <= len(new):
                new = np.sort(np.concatenate([self.runs.pop(), new]))
            self.runs.append(new)
        return False


class Conversation:
    """Rows of one conversation in order: faults as they come, edits and repaired rows at its end."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = None
        self.turns = 0
        self.signs = bytearray()
        self.before: str | None = None
        self.seen = Seen()
        self.rows: list[tuple[int | None, str, str]] = []
        self.bytes = 0
        self.file = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        said = text.rstrip(SPACE)
        key = role.encode("utf-8", "surrogatepass")
        again = self.seen.again(blake2b(len(key).to_bytes(8, "little") + key + text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        fault = "blank" if not said else "duplicate" if again else "truncated" if said[-1] not in ".!?" else ""
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.faults["illegal"] += 1
        self.before = role[:1]
        self.signs += sign(role[:1], fault).encode()
        self.rows.append((turn, role, text))
        self.bytes += len(text) + 64
        if self.bytes > HELD_BYTES:
            self._to_file()

    def _to_file(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="conversation-")
        pickle.dump(self.rows, self.file)
        self.rows, self.bytes = [], 0

    def _all(self) -> Iterator[tuple[int | None, str, str]]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.rows

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def repaired(self, audit: str) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) of every row that is there after the edits."""
        rows, state = self._all(), START
        for e in audit:
            if e == "I":
                turn, role, text = None, ROLES[NEXT[state]], ""
            else:
                turn, role, text = next(rows)
                if e == "D":
                    continue
                role = ROLES[NEXT[state]] if e == "R" else role
            state = STEP[state][role[0]]
            yield e, turn, role, text


def _conversations(it: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """The conversations of rows sorted by id and order."""
    now: Conversation | None = None
    for batch in it:
        for conv, turn, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or conv != now.conv_id:
                if now is not None:
                    yield now
                now = Conversation(conv)
            for _ in range(copies):
                now.add(turn, role, text)
    if now is not None:
        yield now


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): one in twenty rows each dropped (no copy), emptied, without its sentence ends, doubled, or given the role user.

    The row's number of twenty is the crc32 of ``conv_id:turn`` (nulls: one space).
    """
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(conv_id), F.lit(":"), one(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order; one without ``copies`` stands once."""
    copies = F.coalesce(F.col("copies"), F.lit(1)) if "copies" in rows.columns else F.lit(1)
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"), copies.cast("int").alias("copies"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and audit of the cheapest edits, digest of the repaired rows.

    ``rows`` are (conv_id, turn, role, text) and, if there, how many ``copies`` of a
    row stand (0: the conversation is there, the row is not).
    """
    dealt = _dealt(rows)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held))
            held.clear()
            types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", *names])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in it:
                kind = batch.schema.field(0).type
                yield batch

        for c in _conversations(watched()):
            cost, audit = repair(c.signs.decode())
            digest = sha256()
            for k, (_, _, role, text) in enumerate(c.repaired(audit)):
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            f = c.faults
            held.append((c.conv_id, c.gaps, f["blank"], f["duplicate"], f["truncated"], f["illegal"], cost, audit, digest.hexdigest()))
            size += len(audit) + 200
            if size > HELD_BYTES // 4:
                yield flush()
                size = 0
        if held:
            yield flush()

    kinds = ", ".join(f"{n} {'string' if n in names[-2:] else 'long'}" for n in names)
    return dealt.mapInArrow(solve, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {kinds}")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows of every repaired conversation, in order by place.

    ``edit`` is K (kept), R (role changed) or I (inserted, without a turn).
    """
    dealt = _dealt(rows)

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, pa.int64()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held))
            held.clear()
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "place", "edit", "turn", "role", "text"])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in it:
                kind = batch.schema.field(0).type
                yield batch

        for c in _conversations(watched()):
            for k, (e, turn, role, text) in enumerate(c.repaired(repair(c.signs.decode())[1])):
                held.append((c.conv_id, k, e, turn, role, text))
                size += len(text) + 200
                if size > HELD_BYTES // 4:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return dealt.mapInArrow(solve, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, turn long, role string, text string")
