"""Tokenizer access: whole texts to ids, through a cache of encoded words.

A BPE tokenizer works on pre-tokens that never reach across a word boundary, so
the ids of a text are the joined ids of its words. Each distinct word is encoded
once by the tokenizers library and then gathered with NumPy. Texts whose white
space would make pre-tokens depend on more than one word are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES, plain, release

#: Words that a worker's cache holds at most, and of them the first, mostly frequent ones, that outlive a task.
CACHE_WORDS, KEPT_WORDS = 600_000, 250_000
#: Two white-space characters in a row, the mark that pieces are split at, or the start of a special token.
_WHOLE = r"[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]{2}|[\x{01}\x{85}\x{1C}-\x{1F}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|<\|"

#: ASCII punctuation, without the apostrophe, at a word's end after an ASCII letter or digit or a Latin-1 letter (case folding turns others into a letter and a mark).
_TAIL = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}](?P<tail>[!-&(-/:-@\[-`{-~]+)$"
#: Words of one pre-token where blanks are dropped; words after one blank.
_ONE_PIECE = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_SPACED = re.compile(r" (?!.*<\|)\S+")
#: Texts are encoded in runs of so many bytes.
RUN = 6 << 20

_OPEN: dict[str, "Encoder"] = {}
CACHES.append(_OPEN.clear)


def encoder(path: str) -> "Encoder":
    """The worker's encoder of this vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class Encoder:
    """ids of whole texts, special tokens never added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        #: Whether white space leaves no trace in the ids (then any blank separates words).
        self.blanks_dropped = '"\\\\s+"' in json.dumps(about.get("normalizer")) and (about["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("behavior") == "Removed"
        self.vocabulary_size = self.tokenizer.get_vocab_size()
        marks = [x for x in about.get("added_tokens", []) if x["special"] and x["content"].startswith("<|") and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"])]
        #: A special token, as text and id, that splits a text before anything else is done to it.
        self.mark = (marks[0]["content"], marks[0]["id"]) if marks else None
        #: By id: whether it ends a word, or where blanks are kept begins one.
        self.edges = np.zeros(max(about["model"]["vocab"].values(), default=0) + 1024, bool)
        for piece, i in about["model"]["vocab"].items():
            self.edges[i] = piece.endswith(about["model"].get("end_of_word_suffix") or "\0") if self.blanks_dropped else piece.startswith("\u0120")
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = array("I")
        self.begin = array("q", [0])

    def close_task(self) -> None:
        """Keep a small cache only, as an executor has several workers that wait between tasks."""
        if len(self.place) > KEPT_WORDS:
            self.place = dict(islice(self.place.items(), KEPT_WORDS))
            del self.begin[KEPT_WORDS + 1 :]
            del self.flat[self.begin[-1] :]
        release()

    def _plain(self, words: list[str]) -> list[str]:
        """Encode words whose ids show where they begin or end, many in one text; returns the others."""
        fits = _ONE_PIECE.fullmatch if self.blanks_dropped else _SPACED.fullmatch
        easy = [w for w in words if fits(w)]
        glue = " " if self.blanks_dropped else ""
        for i in range(0, len(easy), 256):
            some = easy[i : i + 256]
            ids = np.array(self.tokenizer.encode(glue.join(some), add_special_tokens=False).ids, np.uint32)
            edge = np.flatnonzero(self.edges[ids])
            if len(edge) != len(some):
                raise ValueError("the ids don't show where words begin and end")
            ends = edge + 1 if self.blanks_dropped else np.append(edge[1:], len(ids))
            self._store(some, ids, ends)
        return [w for w in words if not fits(w)]

    def _store(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        base, first = len(self.flat), len(self.place)
        self.flat.frombytes(ids.tobytes())
        self.begin.frombytes((ends + base).astype(np.int64).tobytes())
        self.place.update(zip(words, range(first, first + len(words))))

    def _learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks, many in one call: a special token between two keeps them apart."""
        words = self._plain(words)
        odd = [w for w in words if "<|" in w] if self.mark else words
        for i in range(0, len(odd), 2048):
            some = odd[i : i + 2048]
            for word, got in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                self.place[word] = len(self.place)
                self.flat.extend(got.ids)
                self.begin.append(len(self.flat))
        if not self.mark:
            return
        text, mark = self.mark
        words = [w for w in words if "<|" not in w] if odd else words
        for i in range(0, len(words), 64):
            some = words[i : i + 64]
            ids = np.array(self.tokenizer.encode(text.join(some) + text, add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(ids == mark)
            if len(ends) != len(some):
                raise ValueError("the special token doesn't keep words apart")
            self._store(some, ids[ids != mark], ends - np.arange(len(ends)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i+1]]; a null is an empty text."""
        texts = plain(texts)
        if self.blanks_dropped:
            return self._gather(pc.ascii_split_whitespace(texts), {})
        whole = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _WHOLE)))
        odd: dict[int, list[int]] = {}
        if len(whole):
            for i in whole.tolist():
                odd[i] = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
            blank = np.ones(len(texts), bool)
            blank[whole] = False
            texts = pc.if_else(pa.array(blank), texts, "")
        pieces = pc.split_pattern(pc.replace_substring(texts, " ", "\x01 "), "\x01")
        return self._gather(pieces, odd)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of distinct words. Each is a stem and a tail of punctuation, which pre-tokens never span."""
        simple = pc.invert(pc.match_substring(words, "<|"))
        if self.blanks_dropped:  # such a tokenizer has only lower-case ids; beyond ASCII, folding and composition could change places
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        tails = pc.if_else(simple, pc.struct_field(pc.extract_regex(words, _TAIL), "tail"), None)
        kept = pc.subtract(pc.binary_length(words), pc.fill_null(pc.binary_length(tails), 0).cast(pa.int64()))
        tailed = np.flatnonzero(np.asarray(pc.is_valid(tails)))
        stems = words
        if len(tailed):
            ends = np.frombuffer((whole := plain(words)).buffers()[1], np.int64)[whole.offset : whole.offset + len(words) + 1]
            size = np.asarray(kept, np.int64)
            raw = np.frombuffer(whole.buffers()[2], np.uint8)
            keep = np.zeros(len(raw) + 1, np.int64)
            np.add.at(keep, ends[:-1], 1)
            np.add.at(keep, ends[:-1] + size, -1)
            raw = raw[np.cumsum(keep[:-1]) > 0]
            stems = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        parts = pa.concat_arrays([stems.cast(pa.large_string()), tails.take(pa.array(tailed)).cast(pa.large_string())]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        if len(self.place) + len(names) > CACHE_WORDS:
            self._clear()
        place = self.place
        self._learn([w for w in names if w not in place])
        at = np.fromiter((place[w] for w in names), np.int64, len(names))[np.asarray(parts.indices, np.int64)]
        begin = np.frombuffer(self.begin, np.int64).copy()
        flat = np.frombuffer(self.flat, np.uint32).copy() if len(self.flat) else np.zeros(0, np.uint32)
        order = np.argsort(np.concatenate((np.arange(len(words)) * 2, tailed * 2 + 1)), kind="stable")
        owner = np.concatenate((np.arange(len(words)), tailed))[order]
        at = at[order]
        sizes = begin[at + 1] - begin[at]
        ends = np.cumsum(sizes)
        take = np.repeat(begin[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.concatenate(([0], np.cumsum(np.bincount(owner, sizes, len(words)).astype(np.int64)))), flat[take]

    def _gather(self, split: pa.Array, odd: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.asarray(split.offsets, np.int64)
        first = offsets[0] if len(offsets) else 0
        coded = split.values.slice(first, offsets[-1] - first).dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        begin, flat = self._words(coded.dictionary)
        at = np.arange(len(begin) - 1)
        sizes = (begin[at + 1] - begin[at])[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(begin[at][codes] - ends[:-1], sizes)
        take += np.arange(len(take))
        ids, ends = flat[take], ends[offsets - first]
        if not odd:
            return ends, ids
        parts, counts = [], np.diff(ends)
        last = 0
        for i, own in sorted(odd.items()):
            parts += [ids[last : ends[i]], np.asarray(own, np.uint32)]
            last, counts[i] = ends[i], len(own)
        return np.concatenate(([0], np.cumsum(counts))), np.concatenate([*parts, ids[last:]])


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id after each text."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = offsets[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = ids, end
    return offsets + np.arange(n + 1), out


def binaries(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary of little-endian 32-bit ids for each range."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
