"""Best-fit packing of token pieces into fixed-size sequences.

The plan is made on the driver from the histogram of lengths alone, which has at
most `capacity` entries whatever the number of pieces. It indexes the sums of
one, two and three lengths, consumes combinations that fill a sequence exactly
as often as the counts allow, and packs what is left by best fit, longest first.
A plan is a list of patterns with repetitions; each pattern uses up one length
at least, so its size depends on the number of lengths and not on that of pieces.

Pieces meet the plan by their rank among pieces of equal length: ranks are counted
in each partition, made global by prefix sums over (length, partition) counts,
and looked up in the plan. No piece moves for it but for one join on small rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, runs, stored
from .tokens import RUN, binaries, encoder, with_end

CAPACITY = 4096
_RANK_BITS = 44


# ---------------------------------------------------------------- pieces
def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: (id, piece, start, length, ids as little-endian 32-bit binary).

    Every text is encoded whole (a null as an empty text) and gets one end id;
    only longer ones are cut. One output set for each input row: repeated rows and
    null ids are kept. Other columns of docs, of any name, play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        own = encoder(tokenizer)
        for batch in batches:
            for run in runs(batch, "text", RUN):
                offsets, ids = with_end(*own.encode(run.column("text")), end_id)
                n = np.diff(offsets)
                times = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                ends = np.concatenate(([0], np.cumsum(length)))
                yield pa.RecordBatch.from_arrays([run.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binaries(ids, ends).cast(pa.binary())], ["id", "piece", "start", "length", "ids"])
        own.close_task()

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- plan
def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, repetitions)]; a pattern lists (length, times) and never exceeds the capacity."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit a sequence of {capacity}")
        have[length] = n
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(*lengths: int) -> bool:
        times: dict[int, int] = {}
        for x in lengths:
            times[x] = times.get(x, 0) + 1
        n = min(int(have[x]) // t for x, t in times.items())
        if n:
            for x, t in times.items():
                have[x] -= n * t
            out.append((sorted(times.items(), reverse=True), n))
        return n > 0

    def pairs_to(gap: int) -> np.ndarray:
        """The larger parts b of the pairs b + c = gap that are at hand."""
        b = np.arange(-(-gap // 2), gap)
        return b[(have[b] > 0) & (have[gap - b] > (2 * b == gap))][::-1]

    if have[capacity]:
        use(capacity)
    for a in range(capacity - 1, 0, -1):  # single lengths that fill the gap
        if have[a] and 2 * a >= capacity:
            use(a, capacity - a)
    for a in range(capacity - 2, 0, -1):  # sums of two
        if have[a]:
            for b in pairs_to(capacity - a):
                if not have[a]:
                    break
                use(a, int(b), capacity - a - int(b))
    sums = np.zeros(capacity + 1, bool)  # sums of two that may be at hand, to find sums of three
    present = np.flatnonzero(have)
    for b in present:
        s = b + present
        sums[s[s <= capacity]] = True
    for a in range(capacity - 3, 0, -1):
        if not have[a]:
            continue
        rest = np.arange(capacity - a - 2, 0, -1)
        for b in rest[(have[rest] > 0) & sums[capacity - a - rest]]:
            if not have[a]:
                break
            gap = capacity - a - int(b)
            found = pairs_to(gap)
            sums[gap] = len(found) > 0
            for c in found:
                if not (have[a] and have[b]):
                    break
                use(a, int(b), int(c), gap - int(c))
    out += _best_fit(have, capacity)
    return out


def _best_fit(have: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts: open sequences of one content are kept as one group."""
    room: list[int] = []  # remaining sizes with open groups, ascending
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(left: int, content: list[tuple[int, int]], n: int) -> None:
        if left not in open_:
            insort(room, left)
            open_[left] = []
        open_[left].append((content, n))

    for a in np.flatnonzero(have)[::-1].tolist():
        m = int(have[a])
        while m:
            i = bisect_left(room, a)
            if i < len(room):
                left = room[i]
                content, n = open_[left].pop()
                if not open_[left]:
                    del open_[left], room[i]
            else:
                left, content, n = capacity, [], m
            q = left // a
            if m >= q:
                k = min(n, m // q)
                put(left - q * a, [*content, (a, q)], k)
                m -= k * q
                spare = n - k
            else:
                put(left - m * a, [*content, (a, m)], 1)
                m, spare = 0, n - 1
            if spare and content:
                put(left, content, spare)
    return [x for groups in open_.values() for x in groups]


def plan_table(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: pieces of a length, from rank lo on, go to sequence base + (rank - lo) // times."""
    rows, used, base = [], {}, 0
    for content, n in patterns:
        offset = 0
        for length, times in content:
            lo = used.get(length, 0)
            rows.append((length << _RANK_BITS | lo, base, times, offset))
            used[length], offset = lo + n * times, offset + length * times
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": cols[0], "base": cols[1], "times": cols[2], "offset": cols[3]}


# ---------------------------------------------------------------- packing
def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: gapless places in sequences of at most `capacity`.

    pieces may have any other columns; sequence_id and offset that it has already are
    replaced. The rows are written to the shared folder, and again with their ranks. An empty table gives an empty table; ties
    take any order among equal lengths, and each row has one place.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    part_col, rank_col, size_col, kind_col, from_col, shift_col, place_col = free_names(["_part", "_rank", "_n", "_length", "_from", "_shift", "_place"], names)
    schema = T.StructType(pieces.schema.fields + [T.StructField(part_col, T.LongType()), T.StructField(rank_col, T.LongType())])
    result = T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def ranked(batches):
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            length = np.asarray(batch.column(length_col), np.int64)
            if len(length) and not (0 < length.min() and length.max() <= capacity):
                raise ValueError("a piece's length doesn't fit a sequence")
            order = np.argsort(length, kind="stable")
            kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(seen[kinds], n)
            seen[kinds] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(rank)], [*batch.schema.names, part_col, rank_col])

    # written first, so that a task needs one worker and not another one for whatever makes the pieces
    held = stored(stored(pieces, "cut").mapInArrow(ranked, schema), "pieces")
    sizes = stored(held.groupBy(F.col(length_col).alias(kind_col), F.col(part_col).alias(from_col)).agg((F.max(rank_col) + 1).alias(size_col)), "sizes")
    counts = {r[kind_col]: r["n"] for r in sizes.groupBy(kind_col).agg(F.sum(size_col).alias("n")).collect()}  # at most `capacity` rows
    table = pieces.sparkSession.sparkContext.broadcast(plan_table(plan(counts, capacity)))
    before = Window.partitionBy(kind_col).orderBy(from_col).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(kind_col, from_col, F.coalesce(F.sum(size_col).over(before), F.lit(0)).alias(shift_col))
    joined = held.join(shift, (F.col(length_col) == F.col(kind_col)) & (F.col(part_col) == F.col(from_col)))

    def placed(batches):
        t = table.value
        for batch in batches:
            length = np.asarray(batch.column(length_col), np.int64)
            rank = np.asarray(batch.column(place_col), np.int64)
            at = np.searchsorted(t["key"], length << _RANK_BITS | rank, side="right") - 1
            nth = rank - (t["key"][at] & ((1 << _RANK_BITS) - 1))
            sequence, slot = t["base"][at] + nth // t["times"][at], nth % t["times"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(t["offset"][at] + slot * length)], [*names, "sequence_id", "offset"])

    return joined.select(*(F.col(f"`{c}`") for c in names), (F.col(rank_col) + F.col(shift_col)).alias(place_col)).mapInArrow(placed, result)
