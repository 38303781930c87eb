"""Pieces that several corpus operators share.

Texts reach Python as Arrow batches and stay Arrow or NumPy arrays: splitting,
case folding and dictionary coding run on whole buffers, and only distinct words
are ever handled one by one.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Bytes of an Arrow batch on its way to a worker: several workers share an executor's memory.
BATCH_BYTES = 6 << 20
#: Texts of one Arrow batch are worked on in runs of at most this many bytes (a longer text is a run of its own).
RUN_BYTES = 24 << 20


# ---------------------------------------------------------------- session
def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors, and bound Arrow batches by bytes, as texts differ in length."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


# ---------------------------------------------------------------- storage
def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests on one machine), a temporary folder is
    made and set for the session.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-shared-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared root."""
    return f"{shared_root(spark)}/plumbline/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() returned and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def free_names(wanted: list[str], taken: list[str]) -> list[str]:
    """The wanted column names, with underscores added where a table has them already (names don't tell case apart)."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def text_bytes(docs: DataFrame, column: str) -> int:
    """Bytes of all texts of a column."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning deals to n different partitions where n is small; with many, chance evens them out."""
    if n > 4096:
        return list(range(n))
    found = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k"))
    return [r["k"] for r in found.orderBy("p").collect()]


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give a worker's freed memory back to the system: workers idle between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What empties caches that a worker keeps between tasks of one kind.
CACHES: list = []


def forget() -> None:
    """Drop what tasks of another kind have left in this worker."""
    for empty in CACHES:
        empty()


def releasing(work):
    """A mapInArrow function that drops other tasks' caches first and releases memory when its task's batches are done."""

    def run(batches):
        forget()
        try:
            yield from work(batches)
        finally:
            release()

    return run


# ---------------------------------------------------------------- texts
def runs(batch: pa.RecordBatch, column: str, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most `most` bytes together."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def plain(texts: pa.Array) -> pa.Array:
    """The texts with nulls as empty strings, offset 0 and 64-bit offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts)


def recoded(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Each byte of the texts replaced by table[byte]; the table must leave bytes over 127 alone."""
    texts = plain(texts)
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = table[raw[offsets[0] : offsets[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw.tobytes())])


def fold_table() -> np.ndarray:
    """A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alnum_table() -> np.ndarray:
    """A-Z to a-z; ASCII bytes that are neither letters nor digits to blanks."""
    table = fold_table()
    for i in range(128):
        if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122):
            table[i] = 32
    return table


class Words:
    """The words of a run of texts: document i has codes[ends[i-1]:ends[i]], indices into `vocabulary`."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None):
        texts = plain(texts) if table is None else recoded(texts, table)
        split = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(split.offsets, np.int64)
        values = split.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else split.values
        offsets = offsets - offsets[0]
        coded = values.dictionary_encode()
        codes = np.asarray(coded.indices, np.int32)
        empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
        if empty >= 0:  # leading or trailing white space
            keep = codes != empty
            kept = np.concatenate(([0], np.cumsum(keep)))
            offsets, codes = kept[offsets], codes[keep]
        self.vocabulary: pa.Array = coded.dictionary
        self.codes = codes
        self.starts = offsets[:-1]
        self.ends = offsets[1:]
        self.counts = self.ends - self.starts

    def rows(self) -> np.ndarray:
        """The document's index of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each entry of the vocabulary."""
        return hashed(self.vocabulary)


def hashed(words: pa.Array) -> np.ndarray:
    """xxh3 of each string."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns cast to the schema."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x.cast(f.type) for f in schema], schema=schema)
