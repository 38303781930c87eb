"""Language-model scores from an n-gram trie in Elias-Fano form.

Level 1 holds the hashes of all training tokens in order, and running sums of their
counts; a token's rank is its code on the levels above. Levels 2 and 3 hold every
n-gram of two and three tokens: monotone pointers give a context's range, inside it
the followers' codes ascend, so a level is one monotone sequence of (context, code),
and a token is sought by successor search relative to its context. Beside it lie
probabilities quantised to 16 bits; backoff weights follow from the pointers.

The levels are cut into shards of SHARD_TOKENS training tokens, however large the
corpus: a pair of tokens belongs to a place among all training tokens, which the
first one's running sum gives, and inside the first one's stretch a hash of the
second one. So a frequent word's pairs are dealt over as many shards as it has
stretches of that size. One pass over the texts counts all pairs and triples, as a
pair's count is the sum of its triples'. A shard is built by one task and written to
the shared folder; scoring tasks map it into memory, or where the folder isn't local
read pages of it.

Probabilities are interpolated by absolute discounting: (count - DISCOUNT) / context
count for n-grams that are there, plus DISCOUNT * followers / context count times the
probability after a shorter context; the shortest is (c + 0.1) / (N + 0.1 (V + 1)).
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, filesystem, fold_table, mix, partition_keys, plain, releasing, runs, shared_folder, stored, text_bytes
from .elias_fano import PARTS, Sequence, encode

DISCOUNT = 0.75
ADDED = 0.1
RUN = 8 << 20
#: Training tokens of a shard of levels 2 and 3, and bytes of texts for a shard of level 1.
SHARD_TOKENS, SHARD_BYTES = 1 << 21, 16 << 20
#: Bytes of pages that a worker keeps of a store that it can't map.
PAGES, PAGE = 128 << 20, 1 << 16
#: The end token's hash.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_STEP = 4096.0  # quantisation steps for a factor of ten


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit steps of their negative logarithm; 0 as the largest."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log10(p) * _STEP), 0, 65534), 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return np.where(q == 65535, 0.0, 10.0 ** (-q.astype(np.float64) / _STEP))


def token_hashes(words: pa.Array) -> np.ndarray:
    """A 63-bit hash of each word: a polynomial of its bytes, scrambled; whole buffers at a time."""
    words = plain(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    size = np.diff(ends)
    factor = np.ones(int(size.max()) + 1, np.uint64)
    factor[1:] = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        factor = np.cumprod(factor)
        value = mix(np.arange(1, 257, dtype=np.uint64))[raw] * factor[np.arange(len(raw)) - np.repeat(ends[:-1], size)]
        return mix(np.add.reduceat(np.append(value, np.uint64(0)), ends[:-1]) + size.astype(np.uint64)) >> np.uint64(1)  # an empty string's sum is arbitrary; no token has it


# ---------------------------------------------------------------- files
def _save(folder: str, name: str, parts: dict[str, np.ndarray]) -> None:
    """Arrays one after the other, each at a multiple of 8 bytes, and a table of contents at the end.

    The file gets its name when it is whole: a task that runs twice writes it twice alike.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    at, contents, draft = 0, [], f"{root}/draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        for key, x in parts.items():
            raw = np.ascontiguousarray(x)
            contents.append(f"{key},{raw.dtype.str},{at},{raw.size}")
            data = raw.tobytes()
            out.write(data + bytes(-len(data) % 8))
            at += len(data) + -len(data) % 8
        tail = ";".join(contents).encode()
        out.write(tail + len(tail).to_bytes(8, "little"))
    from pyarrow import fs as pafs

    if fs.type_name != "local" and fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{root}/{name}")
    fs.move(draft, f"{root}/{name}")


_HELD: OrderedDict[tuple, np.ndarray] = OrderedDict()  # pages, those used last at the end


class Paged:
    """An array of a file in a store: places are read by the page."""

    def __init__(self, file, name: str, kind: np.dtype, at: int, n: int):
        self.file, self.name, self.kind, self.at, self.n = file, name, kind, at, n
        self.each = PAGE // kind.itemsize

    def __len__(self) -> int:
        return self.n

    def _page(self, i: int) -> np.ndarray:
        key = (self.name, self.at, i)
        if key not in _HELD:
            n = min(self.each, self.n - i * self.each)
            _HELD[key] = np.frombuffer(self.file.read_at(n * self.kind.itemsize, self.at + i * PAGE), self.kind)
            if len(_HELD) > PAGES // PAGE:
                _HELD.popitem(last=False)
        _HELD.move_to_end(key)
        return _HELD[key]

    def take(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), self.kind)
        order = np.argsort(places, kind="stable")
        page = places[order] // self.each
        cut = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1]))) if len(page) else np.zeros(0, np.int64)
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(page)]):
            out[order[s:e]] = self._page(int(page[s]))[places[order[s:e]] % self.each]
        return out


def _load(folder: str, name: str, paged: bool | None = None) -> dict:
    """The arrays of a file: views of a memory map where the folder is local, else paged."""
    fs, root = filesystem(folder)
    path = f"{root}/{name}"
    if paged is None:
        paged = fs.type_name != "local"
    if paged:
        file = fs.open_input_file(path)
        end = file.size()
        size = int.from_bytes(file.read_at(8, end - 8), "little")
        contents = file.read_at(size, end - 8 - size).decode()
    else:
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[-8:].tobytes(), "little")
        contents = raw[-8 - size : -8].tobytes().decode()
    out = {}
    for entry in contents.split(";"):
        key, kind, at, n = entry.split(",")
        kind = np.dtype(kind)
        if not paged:
            out[key] = np.ndarray((int(n),), kind, raw, int(at))
        elif key.endswith(("tops", "shape", "base")):  # small: read at once
            out[key] = np.frombuffer(file.read_at(int(n) * kind.itemsize, int(at)), kind)
        else:
            out[key] = Paged(file, path, kind, int(at), int(n))
    return out


def _sequence(parts: dict, prefix: str) -> Sequence:
    return Sequence({k: parts[f"{prefix}_{k}"] for k in PARTS})


def _parts(prefix: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{prefix}_{k}": x for k, x in encode(values).items()}


def _ranges(which: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, places) for each distinct value."""
    order = np.argsort(which, kind="stable")
    ranked = which[order]
    cut = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(which) else np.zeros(0, np.int64)
    return [(int(ranked[s]), order[s:e]) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(which)])]


class Trie:
    """All levels, over the shared folder; a worker opens a shard when it is first asked for it.

    What travels with it has a few numbers for each shard.
    """

    def __init__(self, folder: str, discount: float, shard_tokens: int, ranks: np.ndarray, sums: np.ndarray):
        self.folder, self.discount, self.each = folder, discount, shard_tokens
        #: Of each shard of level 1, and behind the last: the first rank, and the count of all tokens before it.
        self.ranks, self.sums = ranks, sums
        self.kinds, self.tokens = int(ranks[-1]), int(sums[-1])
        #: Bits of a code.
        self.bits = max(1, self.kinds.bit_length())
        self.shards = -(-self.tokens // shard_tokens)
        self.there = np.zeros(self.shards, bool)
        #: Words whose pairs may lie in more than one shard, and the numbers of their followers.
        self.split, self.followers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: dict[tuple[str, int], dict] = {}

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def shard(self, level: str, i: int) -> dict:
        """The sequences and arrays of a shard."""
        if (level, i) not in self.open:
            parts = _load(self.folder, f"{level}-{i:08d}")
            names = ("keys", "sums") if level == "one" else ("keys2", "pointers2", "keys3", "pointers3")
            self.open[level, i] = {**{k: v for k, v in parts.items() if k in ("prob2", "prob3", "base")}, **{k: _sequence(parts, k) for k in names}}
        return self.open[level, i]

    def first(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank or -1, count, tokens before it) of each token hash on level 1."""
        rank, count, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for s, own in _ranges(level1_shard(hashes, len(self.ranks) - 1)):
            if self.ranks[s + 1] == self.ranks[s]:
                continue
            level = self.shard("one", s)
            own = own[np.argsort(hashes[own])]
            found = level["keys"].find(hashes[own])
            own, found = own[found >= 0], found[found >= 0]
            here, step = level["sums"].steps(found)
            rank[own], before[own], count[own] = found + self.ranks[s], here.astype(np.int64) + self.sums[s], step
        return rank, count, before

    def counts(self, low: int, high: int) -> np.ndarray:
        """The counts of the tokens of these ranks."""
        out = []
        for s in range(int(np.searchsorted(self.ranks, low, side="right")) - 1, len(self.ranks) - 1):
            a, b = max(low, int(self.ranks[s])), min(high, int(self.ranks[s + 1]))
            if a >= high:
                break
            if a < b:
                out.append(np.diff(self.shard("one", s)["sums"].get(np.arange(a, b + 1) - int(self.ranks[s])).astype(np.int64)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def shard_of(self, before: np.ndarray, count: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The shard of pairs, from the first token's sum and count and the second one's rank."""
        part = mix(second.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)  # 24 bits
        return (before + (part * count.astype(np.uint64) >> np.uint64(24)).astype(np.int64)) // self.each

    def pairs(self, shard: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, probability, followers of the first token in its shard) of pairs of ranks."""
        place, prob, count = np.full(len(shard), -1, np.int64), np.zeros(len(shard)), np.zeros(len(shard), np.int64)
        for s, own in _ranges(shard):
            if not self.there[s]:
                continue
            level = self.shard("more", s)
            context = first[own] - int(np.asarray(level["base"])[0])
            inside = (context >= 0) & (context < level["pointers2"].size - 1)
            own, context = own[inside], context[inside]
            at, which = _steps(context)
            count[own] = level["pointers2"].steps(at)[1][which]
            asked = count[own] > 0
            own, context = own[asked], context[asked]
            found = level["keys2"].find(context.astype(np.uint64) << np.uint64(self.bits) | second[own].astype(np.uint64))
            own, found = own[found >= 0], found[found >= 0]
            place[own], prob[own] = found, restored(level["prob2"].take(found))
        return place, prob, count

    def triples(self, shard: np.ndarray, pair: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, followers of the pair) of triples: a place of level 2 and a rank, or -1 for a token that isn't there."""
        prob, count = np.zeros(len(shard)), np.zeros(len(shard), np.int64)
        for s, own in _ranges(shard):
            level = self.shard("more", s)
            at, which = _steps(pair[own])
            count[own] = level["pointers3"].steps(at)[1][which]
            own = own[(count[own] > 0) & (third[own] >= 0)]
            found = level["keys3"].find(pair[own].astype(np.uint64) << np.uint64(self.bits) | third[own].astype(np.uint64))
            own, found = own[found >= 0], found[found >= 0]
            prob[own] = restored(level["prob3"].take(found))
        return prob, count


def level1_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes >> np.uint64(39)) * np.uint64(n)) >> np.uint64(24)).astype(np.int64)


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, which one each is) of values of which equal ones are neighbours."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    new = np.concatenate(([True], x[1:] != x[:-1]))
    return x[new], np.cumsum(new) - 1


# ---------------------------------------------------------------- tokens
class Tokens:
    """The tokens of a run of texts, an end token after each, as codes into hashes; the end's code is the last."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, fold_table())
        self.hashes = np.concatenate((token_hashes(words.vocabulary), [END]))
        n = len(words.counts)
        self.counts = words.counts + 1
        self.ends = np.cumsum(self.counts)
        self.codes = np.empty(len(words.codes) + n, np.int32)
        self.last = np.zeros(len(self.codes), bool)
        self.last[self.ends - 1] = True
        self.codes[self.last], self.codes[~self.last] = len(self.hashes) - 1, words.codes

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


class Ranked:
    """The tokens of a run with codes in the order of their ranks: `code` by token; rank, count, before by code. Unknown tokens have code 0."""

    def __init__(self, trie: Trie, tokens: Tokens):
        rank, count, before = trie.first(tokens.hashes)
        known = np.flatnonzero(rank >= 0)
        known = known[np.argsort(rank[known])]
        code = np.zeros(len(rank), np.int64)
        code[known] = np.arange(1, len(known) + 1)
        self.by_word = count
        self.code = code[tokens.codes]
        self.rank, self.count, self.before = (np.concatenate(([x], y[known])) for x, y in ((-1, rank), (0, count), (0, before)))
        self.bits = max(1, len(known).bit_length())
        #: Places with a token behind them.
        self.starts = np.flatnonzero(~tokens.last)
        #: Of these, whether two tokens stand behind them.
        self.long = ~tokens.last[self.starts + 1]


def _grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, which one each key is), ascending; a sort of keys and places packed in one word where both fit, as that is the fastest."""
    at = max(1, len(key).bit_length())
    if bits + at <= 64:
        packed = np.sort(key.astype(np.uint64) << np.uint64(at) | np.arange(len(key), dtype=np.uint64))
        order = (packed & np.uint64((1 << at) - 1)).astype(np.int64)
        ranked = packed >> np.uint64(at)
    else:
        order = np.argsort(key)
        ranked = key[order]
    found, number = _steps(ranked)
    which = np.empty(len(key), np.int64)
    which[order] = number
    return found.astype(np.int64), which


def _counted(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int, times: np.ndarray | None = None, first_bits: int | None = None) -> tuple[np.ndarray, ...]:
    """(a, b, c, count) of distinct triples of non-negative numbers below 2**bits, ascending."""
    if (first_bits or bits) + 2 * bits <= 64:
        shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        key = (a.astype(np.uint64) << shift | b.astype(np.uint64)) << shift | c.astype(np.uint64)
        key = np.sort(key if times is None else np.repeat(key, times))
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        one = key[new]
        return (one >> np.uint64(2 * bits)).astype(np.int64), (one >> shift & mask).astype(np.int64), (one & mask).astype(np.int64), np.diff(np.append(new, len(key)))
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(a))) if times is None else np.add.reduceat(times[order], new) if len(new) else new
    return a[new].astype(np.int64), b[new].astype(np.int64), c[new].astype(np.int64), n


# ---------------------------------------------------------------- building
def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers below 256**width byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.int64)


def _level_one(docs: DataFrame, folder: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Write level 1; (first ranks, sums) of its shards."""
    buckets = partition_keys(docs.sparkSession, n)

    def count(batches):
        for batch in batches:
            for run in runs(batch, "text", RUN):
                tokens = Tokens(run.column("text"))
                total = np.bincount(tokens.codes, minlength=len(tokens.hashes))
                live = np.flatnonzero(total)
                own = tokens.hashes[live]
                out = [(buckets[s], s, own[at].tobytes(), total[live[at]].astype(np.uint32).tobytes()) for s, at in _ranges(level1_shard(own, n))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "shard", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, at = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64), return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32), len(keys)).astype(np.int64)
        _save(folder, f"one-{shard:08d}", {**_parts("keys", keys), **_parts("sums", np.concatenate(([0], np.cumsum(total))).astype(np.uint64))})
        return pa.table({"shard": pa.array([shard], pa.int32()), "kinds": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(total.sum())], pa.int64())})

    packed = docs.mapInArrow(releasing(count), "bucket int, shard int, keys binary, counts binary")
    kinds, tokens = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    table = stored(packed.repartition(n, "bucket").groupBy("bucket").applyInArrow(merge, "shard int, kinds long, tokens long"), "level")
    for r in table.collect():  # a row for each shard
        kinds[r["shard"] + 1], tokens[r["shard"] + 1] = r["kinds"], r["tokens"]
    discard(table)
    return np.cumsum(kinds), np.cumsum(tokens)


def _shard(trie: Trie, shard: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, times: np.ndarray, end: int) -> tuple:
    """Write a shard of levels 2 and 3 from packed triples; its row for the driver."""
    base = int(a.min())
    words = int(a.max()) - base + 1
    a, b, c, n3 = _counted(a - base, b, c, trie.bits, times, max(1, words.bit_length()))
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    pair = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    n2 = np.add.reduceat(n3, new)
    a2, b2 = a[new], b[new]
    whole = trie.counts(base, base + words)
    prob2 = (n2 - trie.discount) / whole[a2]
    followers = np.bincount(a2, minlength=words)
    on = b != end
    prob3 = (n3[on] - trie.discount) / n2[pair[on]]
    shift, ends = np.uint64(trie.bits), lambda n: np.concatenate(([0], np.cumsum(n))).astype(np.uint64)
    _save(trie.folder, f"more-{shard:08d}", {
        "base": np.array([base], np.int64),
        **_parts("keys2", a2.astype(np.uint64) << shift | b2.astype(np.uint64)),
        **_parts("pointers2", ends(followers)),
        "prob2": quantised(prob2),
        **_parts("keys3", pair[on].astype(np.uint64) << shift | c[on].astype(np.uint64)),
        **_parts("pointers3", ends(np.bincount(pair[on], minlength=len(new)))),
        "prob3": quantised(prob3),
    })
    return shard, base, base + words - 1, int(followers[0]), int(followers[-1])


def build(docs: DataFrame, discount: float = DISCOUNT, learn: Column | None = None, text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> Trie:
    """The trie of all texts of docs for which `learn` holds (a null text is an empty one).

    Counts cover every such text whole. An empty table gives a trie without tokens.
    """
    if not 0 < discount < 1:
        raise ValueError("the discount must lie between 0 and 1")
    spark = docs.sparkSession
    folder = shared_folder(spark, "trie")
    source = docs.where(learn) if learn is not None else docs
    source = source.select(F.col(text_col).alias("text"))
    trie = Trie(folder, discount, shard_tokens, *_level_one(source, folder, max(1, -(-text_bytes(source, "text") // SHARD_BYTES))))
    if not trie.tokens:
        return trie
    if 2 * trie.bits > 62 or int(np.diff(trie.sums).max()) >= 1 << 40:
        raise ValueError("too many tokens for this coding")
    width = -(-trie.bits // 8)
    end = int(trie.first(np.array([END]))[0][0])
    known = spark.sparkContext.broadcast(trie)
    keys = partition_keys(spark, trie.shards)

    def count(batches):
        t = known.value
        for batch in batches:
            for run in runs(batch, "text", RUN):
                tokens = Tokens(run.column("text"))
                own = Ranked(t, tokens)
                at = own.starts
                a, b, c, n = _counted(own.code[at], own.code[at + 1], np.where(own.long, own.code[np.minimum(at + 2, len(own.code) - 1)], 0), own.bits)
                del tokens
                shard = t.shard_of(own.before[a], own.count[a], own.rank[b])
                out = []
                for s, at in _ranges(shard):
                    heads, sizes = _steps(a[at])
                    sizes = np.bincount(sizes)
                    wide = max(1, -(-int(max(n[at].max(), sizes.max())).bit_length() // 8))
                    out.append((keys[s], s, wide, _planes(own.rank[heads], width), _planes(sizes, wide), _planes(own.rank[b[at]], width), _planes(np.maximum(own.rank[c[at]], 0), width), _planes(n[at], wide)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (*[pa.int32()] * 3, *[pa.binary()] * 5))], ["bucket", "shard", "wide", "heads", "sizes", "seconds", "thirds", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        t = known.value
        wide = table.column("wide").to_pylist()
        parts = {k: table.column(k).to_pylist() for k in ("heads", "sizes", "seconds", "thirds", "counts")}
        shard = table.column("shard")[0].as_py()
        same = lambda k: np.concatenate([_unplaned(x, width) for x in parts.pop(k)])
        own = lambda k: np.concatenate([_unplaned(x, w) for x, w in zip(parts.pop(k), wide)])
        row = _shard(t, shard, np.repeat(same("heads"), own("sizes")), same("seconds"), same("thirds"), own("counts"), end)
        t.open.clear()
        return pa.table({k: pa.array([x], f) for (k, f), x in zip((("shard", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("of_low", pa.int64()), ("of_high", pa.int64())), row)})

    packed = source.mapInArrow(releasing(count), "bucket int, shard int, wide int, heads binary, sizes binary, seconds binary, thirds binary, counts binary")
    table = stored(packed.repartition(trie.shards, "bucket").groupBy("bucket").applyInArrow(merge, "shard int, low long, high long, of_low long, of_high long"), "level")
    made = table.collect()  # a row for each shard
    discard(table)
    followers: dict[int, int] = {}
    for r in made:  # only a shard's first and last word can reach into others
        trie.there[r["shard"]] = True
        for word, n in {r["low"]: r["of_low"], r["high"]: r["of_high"]}.items():
            followers[word] = followers.get(word, 0) + n
    trie.split = np.array(sorted(followers), np.int64)
    trie.followers = np.array([followers[w] for w in trie.split.tolist()], np.int64)
    return trie


# ---------------------------------------------------------------- scoring
def probabilities(t: Trie, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each token, training count by code): each distinct n-gram of the run is asked for once."""
    own = Ranked(t, tokens)
    single = (own.count + ADDED) / (t.tokens + ADDED * (t.kinds + 1))
    p = single[own.code]
    at, long = own.starts, own.long
    context = own.rank[own.code[at]] >= 0
    at, long = at[context], long[context]
    if not len(at) or not t.there.any():
        return p, own.by_word
    pairs, which = _grouped(own.code[at] << own.bits | own.code[at + 1], 2 * own.bits)
    a, b = pairs >> own.bits, pairs & ((1 << own.bits) - 1)
    shard = t.shard_of(own.before[a], own.count[a], np.maximum(own.rank[b], 0))
    place, prob, followers = t.pairs(shard, own.rank[a], own.rank[b])
    if len(t.split):
        near = np.minimum(np.searchsorted(t.split, own.rank[a]), len(t.split) - 1)
        followers = np.where(t.split[near] == own.rank[a], t.followers[near], followers)
    count = own.count[a].astype(np.float64)
    p[at + 1] = (prob + t.discount * followers / count * single[b])[which]
    deep = long & (place[which] >= 0)
    at, which = at[deep], which[deep]
    if len(at):
        triples, third = _grouped(which << own.bits | own.code[at + 2], own.bits + max(1, len(pairs).bit_length()))
        pair = triples >> own.bits
        prob3, followers3 = t.triples(shard[pair], place[pair], own.rank[triples & ((1 << own.bits) - 1)])
        total = np.maximum(np.round(prob[pair] * count[pair] + t.discount), 1)  # the pair's count
        p[at + 2] = prob3[third] + (t.discount * followers3 / total)[third] * p[at + 2]
    return p, own.by_word


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, in one pass without a shuffle.

    Tokens are the words of the whole text, A-Z folded, and one end; a null text is
    an empty one. score is the log10 probability of the tokens under the trie,
    base_score that under smoothed single counts. Repeated and null ids get a row
    each; other columns play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(trie)

    def rate(batches):
        t = known.value
        for batch in batches:
            for run in runs(batch, "text", RUN):
                tokens = Tokens(run.column("text"))
                p, count = probabilities(t, tokens)
                base = np.log10((count + ADDED) / (t.tokens + ADDED * (t.kinds + 1)))[tokens.codes]
                rows, n = tokens.rows(), run.num_rows
                total = lambda x: np.bincount(rows, x, n)
                yield pa.RecordBatch.from_arrays(
                    [run.column("id"), pa.array(tokens.counts, pa.int64()), pa.array(total(count[tokens.codes] > 0).astype(np.int64)), pa.array(np.full(n, t.tokens, np.int64)), pa.array(total(base)), pa.array(total(np.log10(p)))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(releasing(rate), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 10; a null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(10)), F.lit(1))
