"""Byte-level BPE ids for many texts: pre-tokens are found with numpy, and each distinct one is encoded once.

The tokenizer file gives the ids. Its pre-tokenizer splits a text into pieces that are encoded each for itself, so a
piece has the same ids wherever it stands. Pieces are found for a whole slice of texts at once, by character class, and
looked up in a table of pieces met before; only new ones go to the tokenizer. Texts with characters whose class could
differ between Unicode versions, or with the string of a special token, go to the tokenizer whole.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import KEPT

#: The characters that \s stands for.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
SLICE_CHARS = 1 << 17
TABLE_BITS = 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point. Unassigned ones and letters beyond the basic plane are left to the tokenizer."""
    out = np.empty(sys.maxunicode + 1, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(len(out)):
        kind = unicodedata.category(chr(i))
        out[i] = UNSURE if kind == "Cn" or i > 0xFFFF and kind[0] in "LN" else kinds.get(kind[0], OTHER)
    out[WHITE_SPACE] = SPACE
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts(chars: np.ndarray, kind: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin. Runs of letters, of numbers, of others; one space goes with the run after it; of longer white
    space the last character stands apart unless the text ends; 's 't 'm 'd 're 've 'll are pieces."""
    n = len(chars)
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    space = kind == SPACE
    plain = chars == 32
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[1:] &= ~(plain[:-1] & ~space[1:])
    begin |= first[:n]
    # The last of several white space characters, if a text goes on behind it.
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1] = False
    last &= ~first[1:]
    last[1:] &= space[:-1]
    begin |= last
    for i in np.flatnonzero((chars == 39) & begin):
        end = i + 1
        while end < min(n, i + 3) and not first[end]:
            end += 1
        tail = chars[i + 1 : end].tobytes().decode("utf-32-le")
        size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            begin[i + 1 : i + 1 + size] = False
            if i + 1 + size < n:
                begin[i + 1 + size] = True
    return np.flatnonzero(begin)


class Encoder:
    """encode(texts) gives the ids of all texts in one array and the number of ids of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        size = 1 << TABLE_BITS
        self.keys, self.checks, self.where = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.pool, self.used, self.entries = np.empty(1 << 20, np.int32), 0, 0
        self.offset, self.length = np.empty(size // 4, np.int64), np.empty(size // 4, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, part, size = [], [], [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                out = self._slice(part)
                ids.append(out[0])
                counts.append(out[1])
                part, size = [], 0
        out = self._slice(part)
        return np.concatenate([*ids, out[0]]), np.concatenate([*counts, out[1]])

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds = classes()
        plain = [not any(s in t for s in self.special) for t in texts]
        chars = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        plain = [p and not (kinds[c] == UNSURE).any() for p, c in zip(plain, chars, strict=True)]
        fast = [c for p, c in zip(plain, chars, strict=True) if p]
        found, sizes = self._pieces(fast) if any(map(len, fast)) else (np.empty(0, np.int32), np.zeros(len(fast), np.int64))
        if all(plain):
            return found, sizes
        parts, at, k, counts = [], 0, 0, []
        for p, text in zip(plain, texts, strict=True):
            if p:
                own, at, k = found[at : at + sizes[k]], at + sizes[k], k + 1
            else:
                own = self.whole(text)
            parts.append(own)
            counts.append(len(own))
        return np.concatenate(parts), np.array(counts, np.int64)

    def _pieces(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(c) for c in parts], np.int64)
        chars = np.concatenate(parts)
        ends = np.cumsum(lengths)
        begin = starts(chars, classes()[chars], (ends - lengths)[lengths > 0])
        stop = np.append(begin[1:], len(chars))
        # Two 64-bit hashes of each piece, from running sums: sum of mix(char) * m^position, divided by m^begin.
        powers, inverse = _powers(len(chars) + 1)
        key = self._hash(chars, begin, stop, powers, inverse, 0)
        check = self._hash(chars, begin, stop, powers, inverse, 1)
        entry = self._find(key, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, once = np.unique(key[new], return_index=True)
            self._learn(chars, begin, stop, key, check, new[once])
            entry = self._find(key, check)
            for i in np.flatnonzero(entry < 0):  # two pieces with one key: the later ones are encoded each time
                entry[i] = self._add(self.whole(_text(chars, begin[i], stop[i])))
        size = self.length[entry].astype(np.int64)
        end = np.cumsum(size)
        total = int(end[-1])
        take = np.arange(total) + np.repeat(self.offset[entry] - (end - size), size)
        per_doc = np.concatenate([[0], end])[np.searchsorted(begin, ends)]
        out = self.pool[take], np.diff(per_doc, prepend=0)
        if self.entries > len(self.keys) // 2:
            self._clear()
        return out

    @staticmethod
    def _hash(chars, begin, stop, powers, inverse, seed):
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_weights(chars, seed) * powers[: len(chars)], out=sums[1:])
        return _mixed((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)) | np.uint64(1)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        slot = (key >> np.uint64(20)) & mask
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            there = self.keys[at]
            hit = (there == key[left]) & (self.checks[at] == check[left])
            out[left[hit]] = self.where[at[hit]]
            left = left[~hit & (there != 0) & (there != key[left])]
            slot[left] = (slot[left] + np.uint64(1)) & mask
        return out

    def _learn(self, chars, begin, stop, key, check, at) -> None:
        pieces = [_text(chars, b, e) for b, e in zip(begin[at].tolist(), stop[at].tolist(), strict=True)]
        split = self.tokenizer.model.tokenize  # a piece needs no more splitting, only merges
        coded = [[t.id for t in split(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_names()))] for p in pieces]
        size = np.fromiter(map(len, coded), np.int32, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(size.sum()))
        self._room(len(flat), len(size))
        entry = np.arange(self.entries, self.entries + len(size))
        self.pool[self.used : self.used + len(flat)] = flat
        self.offset[entry], self.length[entry] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)
        self.entries += len(size)
        mask = np.uint64(len(self.keys) - 1)
        slot, left = (key[at] >> np.uint64(20)) & mask, np.arange(len(at))
        while len(left):  # one key a free slot; the others try the next
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.checks[slot[put]], self.where[slot[put]] = key[at[put]], check[at[put]], entry[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + (self.keys[slot[left]] != 0)) & mask

    def _room(self, ids: int, entries: int) -> None:
        while self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.entries + entries >= len(self.offset):
            self.offset, self.length = np.append(self.offset, np.empty_like(self.offset)), np.append(self.length, np.empty_like(self.length))

    def _add(self, ids: np.ndarray) -> int:
        self._room(len(ids), 1)
        self.pool[self.used : self.used + len(ids)] = ids
        self.offset[self.entries], self.length[self.entries] = self.used, len(ids)
        self.used += len(ids)
        self.entries += 1
        return self.entries - 1


@lru_cache(1)
def byte_names() -> dict[int, int]:
    """The characters by which the vocabulary writes bytes: printable ones stand for themselves, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


def _text(chars: np.ndarray, begin: int, stop: int) -> str:
    return chars[begin:stop].tobytes().decode("utf-32-le", "surrogatepass")


def _weights(chars: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(chars.astype(np.uint64) * np.uint64(2) + np.uint64((1 + seed) * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept and lengthened on demand."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps its pieces from task to task."""
    return Encoder(path)


def forget() -> None:
    """Drops the encoder with its pieces, and the powers beside it, from this process."""
    encoder.cache_clear()
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


KEPT.append(forget)
