"""Monotone sequences in chunked Elias-Fano form, read by rank and select without decoding a chunk.

A chunk holds CHUNK values less its first one: low bits packed side by side, as many
as the chunk's span asks for, and high bits in unary. An entry's place in the unary bits shows its high part, so a value is
read by one select, and sought by one select and a few low parts. All lookups work
on many queries at once. The parts are plain arrays of which only the touched
entries are read: mapped into memory, or paged in from a store.
"""

from __future__ import annotations

import numpy as np

CHUNK = 64
_SHIFT = 6
_WORDS = 3  # 64-bit words of a chunk's high bits: CHUNK ones and at most 2 * CHUNK zeros
#: Queries are answered in blocks that stay in a processor's cache.
BLOCK = 1 << 15
#: One head in so many is kept in memory where the heads are paged in.
TOP = 256
PARTS = ("heads", "tops", "high", "low", "place", "shape")
_ONE = np.uint64(1)
_63 = np.uint64(63)


def _packed(values: np.ndarray, widths: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The values' low bits side by side: a chunk's `widths` bits each from word `place` on, and two words more at the end."""
    out = np.zeros(int(place[-1]) + 2, np.uint64)
    for i in range(0, len(widths), 1 << 14):  # chunks; a value reaches into two words at most
        width = np.repeat(widths[i : i + (1 << 14)], CHUNK)
        bit = np.repeat(place[i : i + (1 << 14)][: len(width) // CHUNK] * 64, CHUNK) + width * np.tile(np.arange(CHUNK), len(width) // CHUNK)
        some = values[i * CHUNK : i * CHUNK + len(width)] & ((_ONE << width.astype(np.uint64)) - _ONE)
        word, at = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, some << at)
        over = np.flatnonzero((bit & 63) + width > 64)
        np.bitwise_or.at(out, word[over] + 1, some[over] >> (np.uint64(64) - at[over]))
    return out


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Parts of a non-decreasing sequence of unsigned 64-bit values."""
    n = len(values)
    chunks = -(-n // CHUNK)
    padded = np.concatenate((values, np.full(chunks * CHUNK - n, values[-1] if n else 0, np.uint64))).astype(np.uint64).reshape(chunks, CHUNK)
    heads = padded[:, 0].copy()
    rest = padded - heads[:, None]
    span = rest[:, -1] // np.uint64(2 * CHUNK - 1)
    widths = sum(((span >> np.uint64(i)) > 0).astype(np.int64) for i in range(58)) if chunks else np.zeros(0, np.int64)  # bits of the span
    high = (rest >> widths.astype(np.uint64)[:, None]).astype(np.int64) + np.arange(CHUNK)
    ones = np.zeros(chunks * _WORDS * 64, np.uint8)
    ones[(high + (np.arange(chunks) * (_WORDS * 64))[:, None]).ravel()] = 1
    place = np.concatenate(([0], np.cumsum(widths)))  # CHUNK values of a width fill as many words
    return {"heads": heads, "tops": heads[::TOP].copy(), "high": np.packbits(ones, bitorder="little").view("<u8"), "low": _packed(rest.ravel(), widths, place), "place": place, "shape": np.array([n], np.int64)}


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one with this rank (from 0) in each word, as 8-bit numbers; both arguments are used up."""
    place = np.zeros(len(word), np.uint8)
    for half in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(word & np.uint64((1 << half) - 1))
        up = (rank >= count).view(np.uint8)
        rank -= count * up
        up *= half
        word >>= up
        place += up
    return place


class Sequence:
    """A sequence over its parts: arrays, or objects with take(places) and len() where parts are paged in."""

    def __init__(self, parts: dict):
        self.heads, self.high, self.low, self.place = parts["heads"], parts["high"], parts["low"], parts["place"]
        self.tops = np.asarray(parts["tops"])
        self.size = int(np.asarray(parts["shape"])[0])
        self.paged = not isinstance(self.heads, np.ndarray)
        self.rows = None if self.paged else self.high.reshape(-1, _WORDS)

    def _chunk(self, values: np.ndarray) -> np.ndarray:
        """The last chunk whose head isn't greater, or -1."""
        if not self.paged:
            return np.searchsorted(self.heads, values, side="right") - 1
        lo = (np.searchsorted(self.tops, values, side="right") - 1) * TOP
        hi = np.minimum(lo + TOP, len(self.heads))  # heads[lo] <= value < heads[hi]
        while (open_ := np.flatnonzero((lo >= 0) & (hi - lo > 1))).size:
            mid = (lo[open_] + hi[open_]) >> 1
            up = self.heads.take(mid) <= values[open_]
            lo[open_], hi[open_] = np.where(up, mid, lo[open_]), np.where(up, hi[open_], mid)
        return np.maximum(lo, -1)

    def _widths(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of the low parts, the word where they begin) of chunks."""
        first = self.place.take(chunk)
        return self.place.take(chunk + 1) - first, first

    def _lows(self, bit: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Low parts of these widths from these bits on."""
        word, at = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low.take(word) >> at
        out |= (self.low.take(word + 1) << _ONE) << (_63 - at)  # a shift by 64 in two steps
        return out & ((_ONE << width.astype(np.uint64)) - _ONE)

    def _words(self, chunk: np.ndarray) -> list[np.ndarray]:
        if not self.paged:
            return list(self.rows[chunk].T)
        return [self.high.take(chunk * _WORDS + j) for j in range(_WORDS)]

    def _which(self, words: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
        """The place in each chunk's high bits of the one with this rank (an 8-bit number)."""
        one = np.bitwise_count(words[0])
        two = one + np.bitwise_count(words[1])
        first, last = rank < one, rank >= two
        word = np.where(first, words[0], np.where(last, words[2], words[1]))
        left = rank - np.where(first, 0, np.where(last, two, one)).astype(np.uint8)
        return _select(word, left).astype(np.int64) + np.where(first, 0, np.where(last, 128, 64))

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at these places."""
        out = np.empty(len(index), np.uint64)
        for i in range(0, len(index), BLOCK):
            at = np.asarray(index[i : i + BLOCK], np.int64)
            chunk, rank = at >> _SHIFT, at & (CHUNK - 1)
            width, first = self._widths(chunk)
            high = (self._which(self._words(chunk), rank.astype(np.uint8)) - rank).astype(np.uint64)
            out[i : i + BLOCK] = (high << width.astype(np.uint64) | self._lows(first * 64 + rank * width, width)) + self.heads.take(chunk)
        return out

    def steps(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values at these places, differences to the next ones); places lie before the last."""
        here, step = np.empty(len(index), np.uint64), np.empty(len(index), np.uint64)
        for i in range(0, len(index), BLOCK):
            at = np.asarray(index[i : i + BLOCK], np.int64)
            chunk, rank = at >> _SHIFT, at & (CHUNK - 1)
            width, first = self._widths(chunk)
            shift, bit, words = width.astype(np.uint64), first * 64 + rank * width, self._words(chunk)
            place = self._which(words, rank.astype(np.uint8))
            own = ((place - rank).astype(np.uint64) << shift) | self._lows(bit, width)
            inner = np.flatnonzero(rank < CHUNK - 1)
            # the next one after the place: in its word, else the first of the words behind it
            word, spot = place[inner] >> 6, (place[inner] & 63).astype(np.uint64)
            w = [x[inner] for x in words]
            rest = [np.where(word > j, 0, np.where(word == j, x & ~((np.uint64(2) << spot) - _ONE), x)) for j, x in enumerate(w)]
            j = np.where(rest[0] != 0, 0, np.where(rest[1] != 0, 1, 2))
            some = np.where(j == 0, rest[0], np.where(j == 1, rest[1], rest[2]))
            nxt = 64 * j + np.bitwise_count((some & (~some + _ONE)) - _ONE)
            value = ((nxt - rank[inner] - 1).astype(np.uint64) << shift[inner]) | self._lows(bit[inner] + width[inner], width[inner])
            gap = np.empty(len(at), np.uint64)
            gap[inner] = value - own[inner]
            own += self.heads.take(chunk)
            if len(inner) < len(at):
                edge = np.flatnonzero(rank == CHUNK - 1)
                gap[edge] = self.heads.take(chunk[edge] + 1) - own[edge]
            here[i : i + BLOCK], step[i : i + BLOCK] = own, gap
        return here, step

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each of these values by successor search, or -1 where it isn't there."""
        out = np.full(len(values), -1, np.int64)
        for i in range(0, len(values) if self.size else 0, BLOCK):
            self._find(np.asarray(values[i : i + BLOCK], np.uint64), out[i : i + BLOCK])
        return out

    def _find(self, values: np.ndarray, out: np.ndarray) -> None:
        chunk = self._chunk(values)
        own = None
        if chunk.min() < 0:
            own = np.flatnonzero(chunk >= 0)
            chunk, values = chunk[own], values[own]
        rest = values - self.heads.take(chunk)
        width, first = self._widths(chunk)
        shift = width.astype(np.uint64)
        high = (rest >> shift).astype(np.int64)
        near = np.flatnonzero((high >= 0) & (high < 2 * CHUNK))
        if len(near) < len(high):
            own = near if own is None else own[near]
            chunk, rest, high, width, first, shift = (x[near] for x in (chunk, rest, high, width, first, shift))
        if not len(high):
            return
        want = rest & ((_ONE << shift) - _ONE)
        # entries with this high part stand behind the zero before it, one for each one that follows
        zero = self._which([~x for x in self._words(chunk)], np.maximum(high - 1, 0).astype(np.uint8))
        rank = np.where(high > 0, zero - high + 1, 0)
        bit, low = chunk * (64 * _WORDS) + high, first * 64
        live, tries = np.arange(len(high)), 0
        while len(live):
            r = rank[live]
            at = bit[live] + r  # behind a chunk's last entry there is a zero
            on = live[(self.high.take(at >> 6) >> (at & 63).astype(np.uint64) & _ONE) > 0]
            r, w = rank[on], width[on]
            found, asked = self._lows(low[on] + r * w, w), want[on]
            hit = np.flatnonzero(found == asked)
            spot = on[hit]
            out[spot if own is None else own[spot]] = chunk[spot] * CHUNK + r[hit]
            live, tries = on[found < asked], tries + 1
            rank[live] += 1
            if tries == 3 and len(live):  # the few entries in long stretches of one high part, by halving
                last = self._which([~x for x in self._words(chunk[live])], high[live].astype(np.uint8)) - high[live]
                a, b = rank[live], last
                while (wide := np.flatnonzero(b - a > 0)).size:
                    mid, q = (a[wide] + b[wide]) >> 1, live[wide]
                    less = self._lows(low[q] + mid * width[q], width[q]) < want[q]
                    a[wide], b[wide] = np.where(less, mid + 1, a[wide]), np.where(less, b[wide], mid)
                rank[live] = a
