"""Token ids as Arrow files of equal-length sequences.

Each file holds a run of documents in ascending id order: record batches with two
fixed-size-list columns, input_ids and mask, all rows of one length, so that a
memory map gives row r as a view at a computed place. Only the last row of a file
is padded, with mask false. Beside it an index file says where each document lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, runs, shuffle_width, stored, text_bytes
from .tokens import RUN, binaries, encoder, with_end

SEQUENCE = 2048
ROWS = 512  # sequences in a record batch
#: Bytes of texts for each file, at most about, and for those of a table that would leave tasks without work; tokens of a batch that is read back.
FILE_BYTES, LEAST_BYTES, BATCH_TOKENS = 256 << 20, 1 << 20, 1 << 20


def file_schema(width: str, sequence: int) -> pa.Schema:
    kind = pa.uint16() if width == "uint16" else pa.uint32()
    return pa.schema([("input_ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class _Writer:
    """One file of sequences: ids go in by any amount, full record batches come out."""

    def __init__(self, sink, width: str, sequence: int):
        self.schema, self.width, self.sequence = file_schema(width, sequence), width, sequence
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= (full := self.sequence * ROWS):
            ids = np.concatenate(self.held)
            whole = len(ids) // full * full
            for i in range(0, whole, full):
                self._write(ids[i : i + full], full)
            self.held, self.waiting = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:used] = True
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(self.width)), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            ids = np.concatenate(self.held)
            rows = -(-len(ids) // self.sequence)
            self._write(np.concatenate((ids, np.zeros(rows * self.sequence - len(ids), ids.dtype))), len(ids))
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, sequence: int = SEQUENCE, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs in ascending id order; returns the manifest: (part, name, n_docs, n_tokens, start).

    A null text is an empty one and gives its end id alone; rows of one id are
    ordered by their texts' hashes and then the texts, null ids come first, an empty table gives no file.
    A file is written under a name of its own try and then renamed, so a task that
    runs again replaces it by the same bytes. The manifest has a row for each file.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        own = encoder(tokenizer)
        width = "uint16" if own.vocabulary_size <= 1 << 16 else "uint32"
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        name = f"{part:06d}"
        paths = [f"{root}/{what}-{name}.arrow" for what in ("tokens", "index")]
        writer = index = None
        held = done = 0
        for batch in batches:
            for run in runs(batch, "text", RUN):
                if writer is None:
                    sinks = [fs.open_output_stream(f"{p}.{attempt}") for p in paths]
                    shape = pa.schema([("id", run.schema.field("id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    writer, index = _Writer(sinks[0], width, sequence), pa.ipc.new_file(sinks[1], shape)
                offsets, ids = with_end(*own.encode(run.column("text")), end_id)
                writer.add(ids)
                index.write_batch(pa.RecordBatch.from_arrays([run.column("id"), pa.array(offsets[:-1] + held), pa.array(np.diff(offsets))], schema=shape))
                held += len(ids)
                done += run.num_rows
        own.close_task()
        if writer is not None:
            writer.close()
            index.close()
            for sink, path in zip(sinks, paths):
                sink.close()
                fs.move(f"{path}.{attempt}", path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([done], pa.int64()), "n_tokens": pa.array([held], pa.int64())})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = text_bytes(source, "text")
    n = files or max(1, -(-size // FILE_BYTES), min(shuffle_width(spark), -(-size // LEAST_BYTES)))
    # the hash splits many rows of one id over files
    dealt = source.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    manifest = stored(dealt.mapInArrow(write, "part int, name string, n_docs long, n_tokens long"), "manifest")
    starts, at = [], 0
    for r in manifest.orderBy("part").collect():  # a row for each file
        starts.append((r["part"], r["name"], r["n_docs"], r["n_tokens"], at, kind))
        at += r["n_tokens"]
    return spark.createDataFrame(starts, "part int, name string, n_docs long, n_tokens long, start long, id_type string")


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: (id, start, n_tokens, ids as little-endian 32-bit binary)."""
    spark: SparkSession = manifest.sparkSession
    kind = (manifest.select("id_type").first() or ["long"])[0]

    def read(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                files = [fs.open_input_file(f"{root}/{what}-{name}.arrow") for what in ("index", "tokens")]
                if fs.type_name == "local":
                    files = [pa.memory_map(f"{root}/{what}-{name}.arrow") for what in ("index", "tokens")]
                index, tokens = (pa.ipc.open_file(f) for f in files)
                sequence = tokens.schema.field("input_ids").type.list_size
                full = sequence * ROWS

                def span(lo: int, hi: int) -> np.ndarray:
                    parts = []
                    for b in range(lo // full, -(-hi // full)):
                        rows = tokens.get_batch(b)
                        ids, mask = np.asarray(rows.column(0).values), rows.column(1).values
                        s, e = max(lo - b * full, 0), min(hi - b * full, len(ids))
                        if not mask.slice(s, e - s).true_count == e - s:
                            raise ValueError(f"{name}: a document lies in the padding")
                        parts.append(ids[s:e])
                    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

                for i in range(index.num_record_batches):
                    rows = index.get_batch(i)
                    start, n = (np.asarray(rows.column(k), np.int64) for k in (1, 2))
                    after, lo = np.cumsum(n), 0
                    while lo < len(start):  # documents of BATCH_TOKENS together, or one
                        hi = max(lo + 1, int(np.searchsorted(after, after[lo] - n[lo] + BATCH_TOKENS, side="right")))
                        some = slice(lo, hi)
                        ends = np.concatenate((start[some], [start[some][-1] + n[some][-1]]))
                        ids = span(ends[0], ends[-1])
                        yield pa.RecordBatch.from_arrays([rows.column(0).slice(lo, hi - lo), pa.array(start[some] + base), pa.array(n[some]), binaries(ids, ends - ends[0]).cast(pa.binary())], ["id", "start", "n_tokens", "ids"])
                        lo = hi

    files = max(manifest.count(), 1)
    dealt = spark.createDataFrame(manifest.select("name", "start").collect(), "name string, start long").repartition(files)
    return dealt.mapInArrow(read, f"id {kind}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
