"""Benchmark decontamination: spans of training texts that occur in test items.

Test items are dealt to blocks of a bounded number of words, whose suffix automata
tasks build and write to the shared folder. Each task streams its texts past all
blocks and keeps those it has opened, as far as a bound on their bytes goes.
"""

from __future__ import annotations

import pickle
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Finder
from .common import CACHES, Words, alnum_table, filesystem, releasing, runs, shared_folder

WINDOW = 10
#: Words of test items in one automaton, about.
BLOCK_WORDS = 100_000
#: Bytes of stored automata that a task keeps open; in memory they take a few times as much.
KEPT_BYTES = 32 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same over characters, in either case.
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _item_words(text: str | None) -> list[str]:
    raw = (text or "").encode().lower()  # bytes: only A-Z change
    return [w.decode() for w in _WORD.findall(raw)]


class _Blocks:
    """The finders of all blocks of items, over the shared folder; a task keeps the last ones it has opened, up to KEPT_BYTES of them."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def __call__(self):
        for path in self.paths:
            if path in _OPEN:
                _OPEN.move_to_end(path)
                yield _OPEN[path][0]
                continue
            fs, at = filesystem(path)
            with fs.open_input_stream(at) as f:
                raw = f.read()
            finder = pickle.loads(raw)
            _OPEN[path] = (finder, len(raw))
            while len(_OPEN) > 1 and sum(n for _, n in _OPEN.values()) > KEPT_BYTES:
                _OPEN.popitem(last=False)
            yield finder


_OPEN: OrderedDict[str, tuple[Finder, int]] = OrderedDict()
CACHES.append(_OPEN.clear)


def _finders(items: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> _Blocks:
    """The finders of the items, built by tasks: items are dealt to blocks of about block_words words by a hash of their id and text, each once.

    What reaches the driver is a path for each block.
    """
    spark = items.sparkSession
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    words = F.size(F.regexp_extract_all("t", F.lit(_PATTERN), F.lit(0)))
    total = own.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    folder = shared_folder(spark, "items")

    def build(group: pa.Table) -> pa.Table:
        number = group.column("block")[0].as_py()
        held = [(i, w) for i, t in sorted(zip(group.column("i").to_pylist(), group.column("t").to_pylist())) if (w := _item_words(t))]
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{number:06d}.pickle") as out:
            out.write(pickle.dumps(Finder(held, window)))
        return pa.table({"path": [f"{folder}/{number:06d}.pickle"]})

    dealt = own.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")).where(words > 0)
    return _Blocks(sorted(r["path"] for r in dealt.groupBy("block").applyInArrow(build, "path string").collect()))


def _found(finders, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """By text: merged spans and the items, over all blocks."""
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for finder in finders():
        for row, (spans, names) in finder.find(words).items():
            held = out.setdefault(row, ([], set()))
            held[0].extend(spans)
            held[1].update(names)
    for row, (spans, names) in out.items():
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out[row] = (merged, names)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, item_ids sorted, spans of words) for each row of docs, in one pass without a shuffle.

    Null and empty texts have no words; items without words match nothing; item
    rows of one id count as one item (a null id as one named null). Repeated and
    null document ids get a row each; other columns, of any name, play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    finders, table = _finders(items, window, block_words, item_col, item_text_col), alnum_table()

    def report(batches):
        for batch in batches:
            for run in runs(batch, "text"):
                words = Words(run.column("text"), table)
                got = _found(finders, words)
                hit = np.zeros(run.num_rows, np.int64)
                for row, (spans, _) in got.items():
                    hit[row] = sum(b - a for a, b in spans)
                none: tuple[list, set] = ([], set())
                pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        run.column("id"),
                        pa.array(words.counts, pa.int64()),
                        pa.array(hit),
                        pa.array([sorted(got.get(i, none)[1]) for i in range(run.num_rows)], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b} for a, b in got.get(i, none)[0]] for i in range(run.num_rows)], pairs),
                    ],
                    ["id", "n_words", "n_hit", "item_ids", "spans"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(releasing(report), f"id {kind}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_covered: float = 0.5, block_words: int = BLOCK_WORDS, text_col: str = "text", chars_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the spans found in test items; rows with more than max_covered of their words in spans go.

    All columns stay; a changed row's chars_col, where there is one, is counted anew.
    A removed span leaves one blank. Rows without a span are returned as they are.
    """
    finders, table = _finders(items, window, block_words, item_col, item_text_col), alnum_table()

    def clean(batches):
        for batch in batches:
            for run in runs(batch, text_col):
                words = Words(run.column(text_col), table)
                got = _found(finders, words)
                if got:
                    at, names = run.schema.get_field_index(text_col), run.schema.names
                    keep = np.ones(run.num_rows, bool)
                    texts = run.column(at).to_pylist()
                    chars = run.column(chars_col).to_pylist() if chars_col in names else None
                    for row, (spans, _) in got.items():
                        if sum(b - a for a, b in spans) > max_covered * words.counts[row]:
                            keep[row] = False
                            continue
                        raw = texts[row].encode()
                        place = [m.span() for m in _WORD.finditer(raw.lower())]
                        parts, last = [], 0
                        for a, b in spans:
                            parts.append(raw[last : place[a][0]].rstrip())
                            last = place[b - 1][1]
                        texts[row] = b" ".join(x for x in [*parts, raw[last:].lstrip()] if x).decode()
                        if chars is not None:
                            chars[row] = pa.scalar(len(texts[row])).cast(run.schema.field(chars_col).type).as_py()
                    columns = list(run.columns)
                    columns[at] = pa.array(texts, run.schema.field(at).type)
                    if chars is not None:
                        columns[names.index(chars_col)] = pa.array(chars, run.schema.field(chars_col).type)
                    run = pa.RecordBatch.from_arrays(columns, schema=run.schema).filter(pa.array(keep))
                yield run

    return docs.mapInArrow(releasing(clean), docs.schema)
