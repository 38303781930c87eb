"""Quality rules on repetition, from suffix arrays over the words of each text.

Many texts are sorted at once: a suffix's first rank is its text and first word,
so suffixes of different texts never meet, and each doubling round re-sorts only
suffixes that are still tied. The longest common prefixes of neighbours give the
LCP intervals; a suffix's deepest interval has the greater of its two neighbour
values, which is the longest substring at that place that occurs again. The union
of these spans is that of all maximal repeats, as a repeat that isn't left-maximal
lies inside the span of the suffix before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, forget, mix, plain, release, releasing, runs

SYMBOLS = b"#*$%&|<>"
BLANKS = bytes([32, *range(9, 14)])
RUN = 2 << 20


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. The base rules come first; repetition is judged on repeats of at least min_repeat words."""

    min_words: int = 10
    window: int = 5
    max_window_percent: int = 20
    min_repeat: int = 6
    max_covered: float = 0.2
    max_longest: int = 30


def suffix_order(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp): suffixes sorted text by text; lcp[j] is shared by entries j-1 and j.

    codes are words as small integers, ends[i] the end of the text that holds i.
    A suffix that ends sorts before a longer one; suffixes of different texts share nothing.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = ends.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels = [rank.astype(np.int32)]
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = order[np.repeat(size > 1, size)]
    h = 1
    while len(tied):
        nxt = tied + h
        inside = nxt < ends[tied]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = rank[tied] * (n + 1) + second
        o = np.argsort(by, kind="stable")
        by, tied = by[o], tied[o]
        group = rank[tied]
        start = np.concatenate(([True], by[1:] != by[:-1]))
        head = np.concatenate(([True], group[1:] != group[:-1]))
        at = np.arange(len(tied))
        rank[tied] = group + np.maximum.accumulate(np.where(start, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        size = np.diff(np.append(np.flatnonzero(start), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        levels.append(rank.astype(np.int32))
        h *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    a, b = array[:-1], array[1:]
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    x, y, got = a[live].copy(), b[live].copy(), np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # equal level-k ranks: the next 2**k words agree (a rank that both share can't run past an end, as ends differ)
        same = (x < ends[a[live]]) & (y < ends[b[live]])
        same[same] = levels[k][x[same]] == levels[k][y[same]]
        step = same * (1 << k)
        x, y, got = x + step, y + step, got + step
    lcp[live + 1] = got
    return array, lcp


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends] - total[starts]


def repeats_of(words: Words, window: int, least: int) -> dict[str, np.ndarray]:
    """For each text: words in windows that repeat, words that repeats of `least` words cover, the longest repeat."""
    n, rows = len(words.codes), words.rows()
    ends = words.ends[rows]
    low = min(window, least)
    out = {k: np.zeros(len(words.counts), np.int64) for k in ("windows", "covered", "longest")}
    at = np.flatnonzero(np.arange(n) + low <= ends)
    if not len(at):
        return out
    value = mix(np.arange(len(words.vocabulary), dtype=np.uint64) + np.uint64(1))[words.codes]
    key = mix(rows[at].astype(np.uint64))
    for k in range(low):  # texts without any repeat of that many words need no suffix array
        key = mix(key + value[at + k])
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    docs = np.unique(rows[at[times[which] > 1]])
    if not len(docs):
        return out
    keep = np.zeros(len(words.counts), bool)
    keep[docs] = True
    keep = keep[rows]
    codes, rows = words.codes[keep], rows[keep]
    counts = words.counts[docs]
    stop = np.cumsum(counts)
    array, lcp = suffix_order(codes, np.repeat(stop, counts))
    longest = np.zeros(len(codes), np.int64)
    longest[array] = np.maximum(lcp, np.append(lcp[1:], 0))
    for name, size, fixed in (("windows", window, True), ("covered", least, False)):
        at = np.flatnonzero(longest >= size)
        out[name][docs] = _sums(_covered(len(codes), at, np.full(len(at), size) if fixed else longest[at]), stop - counts, stop)
    out["longest"][docs] = np.maximum.reduceat(longest, stop - counts)
    return out


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text: lines with a word that equal an earlier line of the text."""
    lines = pc.split_pattern(plain(texts), "\n")
    offsets = np.asarray(lines.offsets, np.int64)
    coded = lines.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    worded = np.asarray(pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]"), bool)[codes]
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    key = rows * (len(coded.dictionary) + 1) + codes
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return np.bincount(rows[worded & ~first], minlength=len(texts)).astype(np.int64)


def judge(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All counts and verdicts of a run of texts; a null counts as an empty text."""
    texts = plain(texts)
    words = Words(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    symbol, letter = np.zeros(256, bool), np.ones(256, bool)
    symbol[list(SYMBOLS)] = True
    letter[list(BLANKS)] = letter[128:192] = False  # 128-191 continue a code point
    got = repeats_of(words, rules.window, rules.min_repeat)
    n = words.counts
    failed = (n < rules.min_words) | (100 * got["windows"] > rules.max_window_percent * n)
    fine = (got["covered"] <= rules.max_covered * n) & (got["longest"] <= rules.max_longest)
    return {
        "n_words": n,
        "word_chars": _sums(letter[raw], offsets[:-1], offsets[1:]),
        "n_symbols": _sums(symbol[raw], offsets[:-1], offsets[1:]),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": got["windows"],
        "base_failed": failed,
        "kept": ~failed & fine,
        "covered_words": got["covered"],
        "longest_repeat": got["longest"],
    }


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def quality_report(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, in one pass and without a shuffle.

    A null text has no words and fails the base rules, as does an empty one. Null
    and repeated ids get a row each; other columns, of any name, play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def report(batches):
        for batch in batches:
            for run in runs(batch, "text", RUN):
                got = judge(run.column("text"), rules)
                yield pa.RecordBatch.from_arrays([run.column("id"), *(pa.array(x) for x in got.values())], ["id", *got])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(releasing(report), f"id {kind}, {_RESULT}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        forget()
        batch = pa.record_batch([texts], ["text"])
        out = [pa.array(judge(run.column("text"), rules)["kept"]) for run in runs(batch, "text", RUN)]
        release()
        return pa.concat_arrays(out) if out else pa.array([], pa.bool_())

    return docs.where(good(F.col(text_col)))
