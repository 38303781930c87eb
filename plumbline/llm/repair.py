"""Repair of conversations whose turns are damaged: the cheapest edits that give a legal order of roles.

The nodes of a graph are (rows consumed, state of the pattern of roles); its arcs
are the edits. Forward minimum costs from the start and backward ones from the end
tell the arcs that lie on some cheapest path: those whose forward cost, own cost and
backward cost sum to the optimum. They form a graph without cycles, as no edit that
stays on a row is free. From the start, a set of states follows the least letter that
a tight arc out of it has, which gives the least of all cheapest edit strings.

A row counts by one byte: its role's initial and its faults. Costs are kept at the
ends of blocks and made again inside, so a conversation takes a byte for each row.
Faults are found without texts: digests meet by conversation, role and digest. Texts
are shuffled once, sorted, and walked along the edit string.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows between kept costs.
BLOCK = 1024
#: Rows of output in a batch, and code points after which a batch is closed.
OUT_ROWS, OUT_CHARS = 4096, 1 << 20
_WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Pattern:
    """An automaton over the initials of roles. State 0 is the start; fill has the one role that a state can be gone on from by an inserted or renamed row."""

    initials: str = "sua"
    #: (state, initial) to state.
    steps: dict = field(default_factory=lambda: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2})
    #: state to (role, state).
    fill: dict = field(default_factory=lambda: {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)})
    accept: frozenset = frozenset({0, 3})
    #: Pairs of initials that may follow each other in a legal conversation.
    pairs: frozenset = frozenset({"su", "ua", "au"})

    @property
    def states(self) -> int:
        return 1 + max(max(a, b) for (a, _), b in self.steps.items())


#: Bits of a row's byte above its initial's index (the last index is any other initial).
DELETE, TRUNCATED = 32, 64


class Edits:
    """Minimum costs and cheapest edits over rows given as bytes."""

    def __init__(self, pattern: Pattern = Pattern(), costs: Costs = Costs()):
        self.pattern, self.costs, self.n = pattern, costs, pattern.states
        self._arcs: dict[int, list[list[tuple[str, int, int]]]] = {}
        self._back: dict = {}
        self._on: dict = {}

    def arcs(self, row: int) -> list[list[tuple[str, int, int]]]:
        """For each state, the edits of a row with this byte: (letter, cost, next state)."""
        if row not in self._arcs:
            p, c, out = self.pattern, self.costs, []
            initial = p.initials[row & 31] if row & 31 < len(p.initials) else ""
            more = c.truncated if row & TRUNCATED else 0
            for q in range(self.n):
                own = [("D", c.delete, q)]
                if not row & DELETE:
                    if (q, initial) in p.steps:
                        own.append(("K", more, p.steps[q, initial]))
                    if q in p.fill:
                        own.append(("R", c.rerole + more, p.fill[q][1]))
                out.append(own)
            self._arcs[row] = out
        return self._arcs[row]

    def _filled_back(self, cost: list) -> list:
        for _ in range(self.n):
            for q, (_, to) in self.pattern.fill.items():
                cost[q] = min(cost[q], cost[to] + self.costs.insert)
        return cost

    def _filled_on(self, cost: list) -> list:
        for _ in range(self.n):
            for q, (_, to) in self.pattern.fill.items():
                cost[to] = min(cost[to], cost[q] + self.costs.insert)
        return cost

    def first(self) -> tuple:
        return tuple(self._filled_on([0] + [math.inf] * (self.n - 1)))

    def last(self) -> tuple:
        return tuple(self._filled_back([0 if q in self.pattern.accept else math.inf for q in range(self.n)]))

    def back(self, after: tuple, row: int) -> tuple[tuple, int]:
        """(costs to the end before a row, less their least; that least) from those after it."""
        if (after, row) not in self._back:
            cost = self._filled_back([min(c + after[to] for _, c, to in own) for own in self.arcs(row)])
            self._back[after, row] = self._split(cost)
        return self._back[after, row]

    def on(self, before: tuple, row: int) -> tuple[tuple, int]:
        """(costs from the start after a row, less their least; that least) from those before it."""
        if (before, row) not in self._on:
            cost = [math.inf] * self.n
            for q, own in enumerate(self.arcs(row)):
                for _, c, to in own:
                    cost[to] = min(cost[to], before[q] + c)
            self._on[before, row] = self._split(self._filled_on(cost))
        return self._on[before, row]

    @staticmethod
    def _split(cost: list) -> tuple[tuple, int]:
        least = min(cost)
        return tuple(c - least for c in cost), int(least)

    def cheapest(self, rows: bytes | bytearray) -> tuple[int, str]:
        """(least cost, least string of edit letters of that cost)."""
        n = len(rows)
        kept = {n: (self.last(), 0)}
        costs, base = kept[n]
        for i in range(n - 1, -1, -1):
            costs, more = self.back(costs, rows[i])
            base += more
            if i % BLOCK == 0:
                kept[i] = (costs, base)
        best = int(kept[0][0][0] + kept[0][1])
        out: list[str] = []
        letters: list[str] = []
        frontier, forward, forward_base = {0}, self.first(), 0
        for start in range(0, n + 1, BLOCK):  # node i stands before row i; node n is the end
            end = min(n, start + BLOCK)
            behind = [None] * (end - start) + [kept[end]]
            for i in range(end - 1, start - 1, -1):
                costs, more = self.back(behind[i + 1 - start][0], rows[i])
                behind[i - start] = (costs, behind[i + 1 - start][1] + more)
            for i in range(start, end):
                here, after = behind[i - start], behind[i + 1 - start]
                arcs, passed = self.arcs(rows[i]), False
                while not passed:
                    tight = [(letter, to, moves) for q in frontier for letter, cost, to, moves in self._from(arcs, q) if forward[q] + forward_base + cost + (after if moves else here)[0][to] + (after if moves else here)[1] == best]
                    letter, _, passed = min(tight, key=lambda x: x[0])
                    frontier = {to for name, to, _ in tight if name == letter}
                    letters.append(letter)
                forward, more = self.on(forward, rows[i])
                forward_base += more
            out.append("".join(letters))
            letters = []
            if end == n:
                break
        while not any(q in self.pattern.accept and forward[q] + forward_base == best for q in frontier):  # edits behind the last row
            last = self.last()
            frontier = {to for q in frontier for _, cost, to, _ in self._from(None, q) if forward[q] + forward_base + cost + last[to] == best}
            out.append("I")
        return best, "".join(out)

    def _from(self, arcs: list | None, q: int) -> Iterator[tuple[str, int, int, bool]]:
        """(letter, cost, next state, whether the row is consumed) of all edits from a state."""
        if q in self.pattern.fill:
            yield "I", self.costs.insert, self.pattern.fill[q][1], False
        if arcs is not None:
            for letter, cost, to in arcs[q]:
                yield letter, cost, to, True


# ---------------------------------------------------------------- rows
def prepared(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None = None) -> DataFrame:
    """(id, turn, role, text, copies, digest): nulls of role and text are one space; copies are how often the row stands there."""
    out = rows.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    return out.withColumn("digest", F.unhex(F.sha2(F.concat_ws("\n", "role", "text"), 256)))


def audit(rows: DataFrame, pattern: Pattern = Pattern(), costs: Costs = Costs()) -> DataFrame:
    """A row for each conversation of prepared rows: (id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    Rows go by turn (nulls first), then role, then the digest of role and text. Each
    counts for its first fault: blank (no character but white space), duplicate (role
    and text stand in an earlier row), truncated (the last character that isn't white
    space is not one of .!?). gaps are turns missing between the least and the
    greatest. illegal counts neighbours whose initials the pattern doesn't pair. The
    letters of audit are Keep, Rerole, Delete (needed for blanks and duplicates) and
    Insert; of the cheapest edits, the least string. A conversation with no copies at
    all has zeros and an empty string; a null id is a conversation of its own.
    """
    kind = rows.schema["id"].dataType.simpleString()
    left = F.rtrim("text", F.lit(_WHITE))
    known = F.expr("CASE " + " ".join(f"WHEN substring(role, 1, 1) = '{c}' THEN {i}" for i, c in enumerate(pattern.initials)) + f" ELSE {len(pattern.initials)} END")
    narrow = rows.select("id", "turn", "role", "digest", "copies", known.alias("code"), (left == "").alias("blank"), (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("cut"))
    # The first turn of each text that a conversation has more than once; all others are alone.
    again = narrow.where("copies > 0 AND NOT blank").groupBy("id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("id_"), F.col("digest").alias("digest_"), "first")
    flagged = narrow.join(again, F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left").withColumn("later", F.coalesce(~F.struct("turn").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull())
    dealt = flagged.select("id", "turn", "role", "digest", "copies", "code", "blank", "cut", "later").repartition("id").sortWithinPartitions("id", "turn", "role", "digest")
    legal = np.zeros((32, 32), bool)
    for a, b in pattern.pairs:
        legal[pattern.initials.index(a), pattern.initials.index(b)] = True

    def work(batches):
        edits, now, state, out, id_type = Edits(pattern, costs), None, None, [], None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for conv, turn, digest, copies, code, blank, cut, later in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "digest", "copies", "code", "blank", "cut", "later"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.close(edits, legal)))
                    now, state = conv, _Conversation()
                if copies:
                    state.add(turn, digest, copies, code, blank, cut, later)
            if out:
                yield _batch(out, id_type)
                out = []
        if state is not None:
            yield _batch([(now, *state.close(edits, legal))], id_type)

    return dealt.select("id", "turn", "digest", "copies", "code", "blank", "cut", "later").mapInArrow(work, f"id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, *[pa.int64()] * 6, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


class _Conversation:
    """A conversation as its rows pass."""

    def __init__(self):
        self.rows = bytearray()
        self.blank = self.duplicate = self.truncated = self.turns = 0
        self.least = self.most = self.before = None

    def add(self, turn, digest, copies, code, blank, cut, later) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        for _ in range(copies):
            row = code
            if blank:
                self.blank, row = self.blank + 1, row | DELETE
            elif later or self.before == (turn, digest):
                self.duplicate, row = self.duplicate + 1, row | DELETE
            elif cut:
                self.truncated, row = self.truncated + 1, row | TRUNCATED
            self.rows.append(row)
            self.before = (turn, digest)

    def close(self, edits: Edits, legal: np.ndarray) -> tuple:
        initials = np.frombuffer(bytes(self.rows), np.uint8) & 31
        illegal = int((~legal[initials[:-1], initials[1:]]).sum())
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, illegal, *edits.cheapest(self.rows))


def repaired(rows: DataFrame, audits: DataFrame, pattern: Pattern = Pattern()) -> DataFrame:
    """The conversations after their edits: (id, place, role, text), each in one partition and in order.

    Inserted rows have the role that the pattern asks for and an empty text; renamed
    ones keep their text. Texts move in one shuffle and pass in sorted order.
    """
    kind = rows.schema["id"].dataType.simpleString()
    plan = audits.select("id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), F.unhex(F.lit("")).alias("digest"))
    said = rows.where("copies > 0").select("id", F.lit(1).alias("part"), "turn", "role", "text", "copies", "digest")
    dealt = plan.unionByName(said).repartition("id").sortWithinPartitions("id", "part", "turn", "role", "digest")

    def work(batches):
        letters, at, state, place, out, size, id_type = "", 0, 0, 0, [], 0, None
        conv = None

        def inserts() -> None:
            nonlocal at, state
            while at < len(letters) and letters[at] == "I":
                role, state = pattern.fill[state]
                put(role, "")
                at += 1

        def put(role: str, text: str) -> None:
            nonlocal place, size
            out.append((conv, place, role, text))
            place, size = place + 1, size + len(text)

        def batch_of() -> pa.RecordBatch:
            nonlocal out, size
            cols, out, size = list(zip(*out)), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.int64(), pa.string(), pa.string()))], ["id", "place", "role", "text"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for own, part, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "role", "text", "copies"))):
                if part == 0:
                    inserts()  # behind the last row of the conversation before
                    conv, letters, at, state, place = own, text, 0, 0, 0
                    continue
                for _ in range(copies):
                    inserts()
                    letter, at = letters[at], at + 1
                    if letter == "K":
                        state = pattern.steps[state, role[:1]]
                        put(role, text)
                    elif letter == "R":
                        name, state = pattern.fill[state]
                        put(name, text)
                if len(out) >= OUT_ROWS or size >= OUT_CHARS:
                    yield batch_of()
            if out:
                yield batch_of()
        inserts()
        if out:
            yield batch_of()

    return dealt.select("id", "part", "role", "text", "copies").mapInArrow(work, f"id {kind}, place long, role string, text string")


def text_digests(turns: DataFrame) -> DataFrame:
    """(id, sha256) of role:text, joined by newlines, of rows as repaired() returns them, before any shuffle."""
    kind = turns.schema["id"].dataType.simpleString()

    def work(batches):
        now, state, out, id_type = None, None, [], None

        def batch_of() -> pa.RecordBatch:
            nonlocal out
            ids, shas = zip(*out)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(shas, pa.string())], ["id", "sha256"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "place", "role", "text"))):
                if place == 0:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield batch_of()
        if state is not None:
            out.append((now, state.hexdigest()))
            yield batch_of()

    return turns.mapInArrow(work, f"id {kind}, sha256 string")


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Prepared rows with damage by crc32 of id:turn modulo 20.

    0 drops the row (no copies), 1 empties its text, 2 removes its .!?, 3 repeats it,
    4 makes its role user. Nulls are one space, in the checksum too.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)))
    which = (F.crc32(name.cast("binary")) % 20).cast("int")
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in (text_col, role_col))
    hurt = conversations.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.when(which == 4, "user").otherwise(role).alias("role"),
        F.when(which == 1, "").when(which == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(which == 0, 0).when(which == 3, 2).otherwise(1).alias("copies"),
    )
    return prepared(hurt, "id", "turn", "role", "text", F.col("copies"))


def report(rows: DataFrame, id_col: str = "conv_id", pattern: Pattern = Pattern(), costs: Costs = Costs()) -> DataFrame:
    """Audits of prepared rows with repaired_sha256, a row for each conversation; an empty table gives nothing."""
    audits = stored(audit(rows, pattern, costs), "audits")
    digests = text_digests(repaired(rows, audits, pattern)).withColumnRenamed("id", "id_")
    whole = audits.join(digests, F.col("id").eqNullSafe(F.col("id_")), "left")
    none = hashlib.sha256().hexdigest()
    return whole.select(F.col("id").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(none)).alias("repaired_sha256"))
