"""Chat formatting with loss masks, by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. Successive
prefixes of a conversation are rendered; where an output extends the one before,
the new part is the new turn's span. A template that changes what it has written
is detected. Inside each learned span, two probe texts of the text's own length show
what stands before and after it; where the span disagrees with that, the text itself is
looked for, and what can't be told is an error. Prefixes are whole, so a template may look at all its history; the work grows
with the square of a conversation's turns. A template that is declared stateless is
rendered after its latest turns alone, and a conversation of any length streams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: For stateless templates: prefixes are cut to their last KEPT turns whenever they have this many.
WHOLE_TURNS, KEPT = 64, 8
#: A chunk of output is closed after so many turns or code points.
CHUNK_TURNS, CHUNK_CHARS = 256, 1 << 20

# The default template's role names and marks.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
OPEN, CLOSE = "### ", "</turn>"
_ESCAPE = re.compile(r"[\\#]|</turn>")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*)</turn>\n", re.S)


class HistoryRewritten(ValueError):
    """The template changed text that it had rendered for earlier turns."""


class FrameUnclear(ValueError):
    """What the template writes around a text depends on the text, and the text isn't found as it stands either."""


def escape(text: str) -> str:
    """A backslash before each backslash, number sign and closing mark: what is left bare is the template's own."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _name(role: str) -> str:
    """How a role is written: known ones by name; any other escaped so that it can't pass for one."""
    if role in NAMES:
        return NAMES[role]
    name = escape(role).replace(":", "\\:")
    return "\\" + name if name in NAMES.values() else name


def marked_turns(turns: list[Turn]) -> str:
    """The default template."""
    return "".join(f"{OPEN}{_name(role)}: {escape(text)}{CLOSE}\n" for role, text in turns)


def parse_turn(text: str) -> Turn:
    """The turn that the default template has written."""
    m = _TURN.fullmatch(text)
    if not m:
        raise ValueError(f"not one turn: {text[:80]!r}")
    known = {v: k for k, v in NAMES.items()}
    return known.get(m[1]) or unescape(m[1]), unescape(m[2])


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class Incremental:
    """Spans of the turns of one conversation, turn by turn.

    stateless declares that a turn is written alike after any KEPT turns that come
    before it, whatever stands further back; only then are prefixes cut.
    """

    def __init__(self, template: Template, whole: int = WHOLE_TURNS, kept: int = KEPT, stateless: bool = False):
        self.template, self.whole, self.kept, self.stateless = template, whole, kept, stateless
        self.turns: list[Turn] = []
        self.last = template([])

    def add(self, role: str, text: str, learned: bool = True) -> tuple[str, int, int]:
        """(new text, place in it where the turn's text begins, place where it ends); an empty span where the text isn't learned."""
        if self.stateless and len(self.turns) >= self.whole:
            self.turns = self.turns[-self.kept :]
            self.last = self.template(self.turns)
        before = self.last
        now = self.template([*self.turns, (role, text)])
        if not now.startswith(before):
            raise HistoryRewritten(f"rendered text changes from code point {common_prefix(before, now)} on when turn {len(self.turns)} is added")
        new = now[len(before) :]
        start, end = self._place(before, role, text, new) if learned else (0, 0)
        self.turns.append((role, text))
        self.last = now
        return new, start, end

    def _place(self, before: str, role: str, text: str, new: str) -> tuple[int, int]:
        """Where a turn's text stands in what the turn adds."""
        a, b = (self.template([*self.turns, (role, probe * max(1, len(text)))]) for probe in "ab")
        if a.startswith(before) and b.startswith(before):
            a, b = a[len(before) :], b[len(before) :]
            head = common_prefix(a, b)
            tail = common_prefix(a[head:][::-1], b[head:][::-1])
            inner = a[head : len(a) - tail], b[head : len(b) - tail]
            apart = len(inner[0]) == len(inner[1]) and not any(x == y for x, y in zip(*inner))  # else the text is written in pieces
            if apart and inner[0] and head + tail <= len(new) and new.startswith(a[:head]) and new.endswith(a[len(a) - tail :]):
                return (head, len(new) - tail) if text else (head, head)
        if not text:
            return len(new), len(new)
        found = new.find(text)
        if found < 0 or new.find(text, found + 1) >= 0:
            raise FrameUnclear(f"turn {len(self.turns)}: what stands around the text depends on it")
        return found, found + len(text)


_CHUNK = "chunk int, text string, turns array<struct<role:string,start:long,end:long,loss_start:long,loss_end:long>>, last boolean"


def format_conversations(rows: DataFrame, template: Template = marked_turns, learn: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stateless: bool = False) -> DataFrame:
    """Formatted conversations in chunks: (id, chunk, text, turns, last), a conversation's chunks in order in one partition.

    turns has each turn's span in the chunk, and for roles in `learn` the span of
    its text, which is the loss mask (else an empty span). Rows go by turn, then
    role and text; null roles and texts are empty; a null id is a conversation of
    its own. A very long text is rendered whole, three times where it is learned. An
    empty table gives nothing. Other columns play no part. stateless is
    for templates that Incremental's docstring describes; others see all their history.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([(k, pa.string() if k == "role" else pa.int64()) for k in ("role", "start", "end", "loss_start", "loss_end")]))

    def render(batches):
        now, state, chunk, parts, turns, size = object(), None, 0, [], [], 0
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal chunk, parts, turns, size
            out.append((now, chunk, "".join(parts), turns, last))
            chunk, parts, turns, size = chunk + 1, [], [], 0

        def batch_of(id_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.int32(), pa.string(), spans, pa.bool_()))], ["id", "chunk", "text", "turns", "last"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("id", "role", "text"))):
                if state is None or conv != now:
                    if state is not None:
                        close(True)
                    now, state, chunk = conv, Incremental(template, stateless=stateless), 0
                    parts, size = [state.last], len(state.last)  # what stands before the first turn
                if len(turns) >= CHUNK_TURNS or size >= CHUNK_CHARS:
                    close(False)
                new, a, b = state.add(role, text, role in learn)
                turns.append({"role": role, "start": size, "end": size + len(new), "loss_start": size + a, "loss_end": size + b})
                parts.append(new)
                size += len(new)
            if out:
                yield batch_of(id_type)
        if state is not None:
            close(True)
            yield batch_of(id_type)

    source = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = source.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return dealt.mapInArrow(render, f"id {kind}, {_CHUNK}").withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, parse: Callable[[str], Turn] = parse_turn, undo: Callable[[str], str] = unescape, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation, from the formatted text and its spans alone.

    Takes chunks as format_conversations returns them, before any shuffle, and
    hashes as they pass: turns_sha256 of role, newline, text, newline for each
    turn; loss_sha256 of all text under the mask, unescaped.
    """
    kind = formatted.schema[id_col].dataType.simpleString()

    def read(batches):
        n = chars = lost = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for conv, text, marks, last in zip(*(batch.column(k).to_pylist() for k in (id_col, "text", "turns", "last"))):
                for t in marks:
                    role, said = parse(text[t["start"] : t["end"]])
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    learned = undo(text[t["loss_start"] : t["loss_end"]])
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                    lost += len(learned)
                n, chars = n + len(marks), chars + len(text)
                if last:
                    out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
                    n = chars = lost = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
            if out:
                types = (batch.schema.field(id_col).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
