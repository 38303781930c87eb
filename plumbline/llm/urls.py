"""URL filtering with a sorted array of digests.

Rules (host, path, verdict) become entries: one for each rule under host#path, and
one for each host that has rules, with the lengths of their paths. Neither a host
nor a path can hold a number sign, so entries of both kinds share one array. Entries
are dealt by their 64-bit xxhash to shards of bounded size; a shard is a file with
its digests in ascending order, the ends of its entries, and the entries' full
strings. Probes are sorted, found by vectorised binary search in the mapped digests
and confirmed by the stored strings, so that equal digests of unlike strings do no
harm. A URL asks for the suffixes of its host, then for its path cut to the lengths
found: what is asked doesn't grow with the number of rules.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, releasing

#: Spark's xxhash64 of one string is XXH64 with this seed.
SEED = 42
#: Bytes of strings and digests in a shard, about: a shard is written by one task, and read at once where its file can't be mapped.
SHARD_BYTES = 64 << 20
#: Shards a worker keeps where files can't be mapped.
KEPT_SHARDS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- parts of a URL
def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, number sign or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to a question mark, number sign or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


# ---------------------------------------------------------------- writing
def write_array(rules: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, bits: int = 64) -> DigestArray:
    """The array of rules (host, path, verdict) as files in the folder.

    Hosts lose upper case; a null path is empty; rules without a host or verdict
    fall out. Where a host and path come with several verdicts, the last in order of
    their names holds (block before allow). No rules give an array without entries.
    Other columns play no part. bits is for tests: so few of a digest's bits are kept.
    """
    spark = rules.sparkSession
    clean = rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict").where("host IS NOT NULL AND verdict IS NOT NULL")
    held = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    by_rule = held.select(F.concat_ws("#", "host", "path").alias("key"), F.col("verdict").alias("value"))
    by_host = held.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set(F.octet_length("path"))), ",").alias("value")).select(F.col("host").alias("key"), "value")
    mask = (1 << bits) - 1
    digest = F.xxhash64("key").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
    entries = by_rule.unionByName(by_host).withColumn("digest", digest)
    total = entries.agg(F.sum(F.octet_length("key") + F.octet_length("value") + 24)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    number = F.shiftright(F.shiftrightunsigned("digest", 40) * F.lit(shards), 24)

    def write(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard = group.column("shard")[0].as_py()
        digests = group.column("digest").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(digests, kind="stable")
        keys, values = ([x.encode() for x in group.column(c).take(pa.array(order)).to_pylist()] for c in ("key", "value"))
        ends = np.cumsum([[len(k), len(v)] for k, v in zip(keys, values)], dtype=np.uint64)
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(_file(path, shard)) as out:
            out.write(np.array([len(order)], np.uint64).tobytes())
            out.write(digests[order].tobytes())
            out.write(ends.astype(np.uint64).tobytes())
            for k, v in zip(keys, values):
                out.write(k + v)
        return pa.table({"shard": pa.array([shard], pa.int64()), "entries": pa.array([len(order)], pa.int64())})

    written = entries.withColumn("shard", number).groupBy("shard").applyInArrow(write, "shard long, entries long")
    return DigestArray(folder, shards, written.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0], mask)


def _file(path: str, shard: int) -> str:
    return f"{path.rstrip('/')}/digests-{shard:08d}.bin"


# ---------------------------------------------------------------- reading
class _Shard:
    """The digests of a shard, and its strings, over a buffer (a mapped file or bytes)."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        n = int(raw[:8].view(np.uint64)[0])
        self.digests = raw[8 : 8 + 8 * n].view(np.uint64)
        self.ends = raw[8 + 8 * n : 8 + 24 * n].view(np.uint64)
        self.first = 8 + 24 * n

    def entry(self, i: int) -> tuple[bytes, bytes]:
        a, b, c = (int(self.ends[j]) if j >= 0 else 0 for j in (2 * i - 1, 2 * i, 2 * i + 1))
        return self.raw[self.first + a : self.first + b].tobytes(), self.raw[self.first + b : self.first + c].tobytes()


class DigestArray:
    """Entries by their strings, over the files that write_array has left; a worker opens a shard when it is first asked for it."""

    def __init__(self, folder: str, shards: int, entries: int, mask: int = (1 << 64) - 1):
        self.folder, self.shards, self.entries, self.mask = folder, shards, entries, mask
        self.open: OrderedDict[int, _Shard | None] = OrderedDict()

    def __getstate__(self):
        return {**self.__dict__, "open": OrderedDict()}

    def shard(self, i: int) -> _Shard | None:
        if i not in self.open:
            from pyarrow import fs as arrow_fs

            fs, path = filesystem(self.folder)
            name = _file(path, i)
            if fs.get_file_info(name).type != arrow_fs.FileType.File:
                self.open[i] = None  # no string has come to this shard
            elif isinstance(fs, arrow_fs.LocalFileSystem):
                self.open[i] = _Shard(np.memmap(name, np.uint8, "r"))
            else:
                with fs.open_input_stream(name) as file:
                    self.open[i] = _Shard(np.frombuffer(file.read(), np.uint8))
                while len(self.open) > KEPT_SHARDS:
                    self.open.popitem(last=False)
        return self.open[i]

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        """The value of each key, or None."""
        out: list[bytes | None] = [None] * len(keys)
        if not keys or not self.entries:
            return out
        digest = xxhash.xxh64_intdigest
        digests = np.fromiter((digest(k, SEED) & self.mask for k in keys), np.uint64, len(keys))
        order = np.argsort(digests)
        asked = digests[order]
        number = ((asked >> np.uint64(40)) * np.uint64(self.shards)) >> np.uint64(24)
        cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if not (held := self.shard(int(number[a]))):
                continue
            low, high = (np.searchsorted(held.digests, asked[a:b], side) for side in ("left", "right"))
            for j in np.flatnonzero(low < high).tolist():
                place = int(order[a + j])
                for i in range(int(low[j]), int(high[j])):  # unlike strings of one digest
                    key, value = held.entry(i)
                    if key == keys[place]:
                        out[place] = value
                        break
        return out


def judge(pages: DataFrame, array: DigestArray, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row.

    A rule fits a URL whose host is the rule's or ends in a dot and the rule's, and
    whose path starts with the rule's. The longest rule, host and path together,
    wins; of two as long, the one with the longer host. rule is its host and path.
    Where none fits, rule is null and the verdict is `default`. Null URLs and those
    without :// have an empty host and path, which no rule fits but one of an empty
    host and path. Repeated rows stay, very long URLs count whole, and an empty
    table gives nothing. Other columns play no part.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hosts, paths = batch.column("host").dictionary_encode(), batch.column("path")
            found = _verdicts(array, hosts, paths, default)
            rule, verdict = (pa.array(x, pa.string()) for x in found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), paths, rule, verdict], ["id", "host", "path", "rule", "verdict"])

    asked = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return asked.mapInArrow(releasing(work), f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _verdicts(array: DigestArray, hosts: pa.DictionaryArray, paths: pa.Array, default: str) -> tuple[list, list]:
    names = [h.encode() for h in hosts.dictionary.to_pylist()]
    suffixes = [[name, *(name[i + 1 :] for i in range(len(name)) if name[i] == 46)] for name in names]  # 46: a dot
    lengths = iter(array.find([s for own in suffixes for s in own]))
    #: Of each distinct host: (suffix that has rules, lengths of their paths).
    ruled = [[(s, [int(x) for x in found.split(b",")]) for s in own if (found := next(lengths)) is not None] for own in suffixes]
    keys, rows = [], []
    indices = hosts.indices.to_pylist()
    some = {i for i, r in enumerate(ruled) if r}
    wanted = [i for i, h in enumerate(indices) if h in some]
    for i, path in zip(wanted, pc.take(paths, pa.array(wanted, pa.int64())).to_pylist()):
        path = path.encode()
        for suffix, sizes in ruled[indices[i]]:
            for n in sizes:
                if n <= len(path):
                    keys.append(suffix + b"#" + path[:n])
                    rows.append(i)
    best: dict[int, tuple] = {}
    for i, key, value in zip(rows, keys, array.find(keys)):
        if value is not None:
            rank = (len(key), key.index(b"#"), key, value)
            if i not in best or rank > best[i]:
                best[i] = rank
    rule, verdict = [None] * len(indices), [default] * len(indices)
    for i, (_, at, key, value) in best.items():
        rule[i], verdict[i] = (key[:at] + key[at + 1 :]).decode(), value.decode()
    return rule, verdict
