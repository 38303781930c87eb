"""A generalised suffix automaton over words, and the windows that it finds in texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class SuffixAutomaton:
    """All substrings of all items, each item a list of small integers.

    Matches are reported by windows: `window` consecutive words of an item, or the
    whole of a shorter one. Feeding words one by one keeps the longest suffix that
    occurs in any item; the windows that end there are the state's ancestors of the
    windows' lengths.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: dict[int, set[str]] = {}  # by the state that holds a full window
        self.short: dict[int, dict[int, set[str]]] = {}  # by the state and length of a shorter item
        for name, words in items:
            state = held = 0
            for w in words:
                state, held = self.step(state, held, w)
                if held >= window:
                    self.items.setdefault(self._window_state(state), set()).add(name)
            if 0 < len(words) < window:
                self.short.setdefault(state, {}).setdefault(len(words), set()).add(name)
        #: The nearest state up the links, itself included, at which a short item ends.
        self.up = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.short else (self.up[self.link[s]] if self.link[s] >= 0 else -1)

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the substrings that end by p's and w."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # an earlier item has it
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return state

    def step(self, state: int, held: int, w: int) -> tuple[int, int]:
        """The state and length of the longest suffix, after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            held = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, held + 1)

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, words: list[int], found: set[str]) -> list[tuple[int, int]]:
        """Spans (start, end) of the windows in these words, merged, in order; adds the items' names to found."""
        spans: list[list[int]] = []
        state = held = 0
        for i, w in enumerate(words):
            state, held = self.step(state, held, w)
            longest = 0
            if held >= self.window:
                longest = self.window
                found |= self.items[self._window_state(state)]
            s = self.up[state]
            while s > 0:
                for n, names in self.short[s].items():
                    if n <= held:
                        found |= names
                        longest = max(longest, n)
                s = self.up[self.link[s]]
            if longest:
                start, end = i + 1 - longest, i + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, end])
        return [(a, b) for a, b in spans]


class Finder:
    """The automaton with its vocabulary, and a filter for the places worth walking.

    The root's transitions of depth two are the word pairs of the items; a match of
    n words needs n - 1 such pairs in a row, so only runs of known pairs are walked.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.words = sorted({w for _, ws in items for w in ws})
        code = {w: i for i, w in enumerate(self.words)}
        coded = [(name, [code[w] for w in ws]) for name, ws in items if ws]
        self.automaton = SuffixAutomaton(coded, window)
        self.least = min((min(window, len(ws)) for _, ws in coded), default=window)
        size = len(self.words) + 1
        self.pairs = np.array(sorted({a * size + b for _, ws in coded for a, b in zip(ws, ws[1:])}), np.int64)

    def find(self, words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text with a match: its spans of words and the items found. words: a run of texts as Words."""
        import pyarrow.compute as pc

        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.words or not len(words.codes):
            return out
        known = pc.index_in(words.vocabulary, value_set=pa.array(self.words, words.vocabulary.type))
        code = np.asarray(pc.fill_null(known, -1), np.int64)[words.codes]
        ends = words.ends[words.rows()]
        n = len(code)
        pair = np.zeros(n, bool)  # this word and the next are known as a pair
        both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (np.arange(1, n) < ends[:-1]))
        if len(both) and len(self.pairs):
            key = code[both] * (len(self.words) + 1) + code[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            pair[both[self.pairs[at] == key]] = True
        fresh = np.concatenate(([True], ~pair[:-1]))  # a run starts here
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, n))
        good = (sizes >= self.least) & (code[starts] >= 0)
        for start, size in zip(starts[good].tolist(), sizes[good].tolist()):
            names: set[str] = set()
            spans = self.automaton.walk(code[start : start + size].tolist(), names)
            if spans:
                row = int(np.searchsorted(words.ends, start, side="right"))
                shift = start - int(words.starts[row])
                held = out.setdefault(row, ([], set()))
                held[0].extend((a + shift, b + shift) for a, b in spans)
                held[1].update(names)
        return out
