"""Words of Arrow string columns as numpy arrays: positions, 64-bit hashes, window hashes.

Texts are read as UTF-8 bytes straight from the Arrow buffers, so a batch of documents is
split and hashed by a fixed number of array operations, without a Python loop over words.
Separators are ASCII in every word definition used here, so byte and character splits agree.
Hashes identify words and windows; two different ones meet with probability 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes hashed at once: keeps the work arrays in cache
SLICE = 2 << 20  # bytes of text handled at once by the operators
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class WordRule:
    """Which bytes belong to words, and the code each byte is hashed by."""

    is_word: np.ndarray  # bool[256]
    code: np.ndarray  # uint64[256]


def _rule(is_word: np.ndarray, lower: bool) -> WordRule:
    code = mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)
    if lower:
        code[65:91] = code[97:123]
    return WordRule(is_word, code)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed one-to-one function)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _non_space() -> np.ndarray:
    m = np.ones(256, dtype=bool)
    m[[0x20, 9, 10, 11, 12, 13]] = False
    return m


def _alphanumeric() -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[0x30:0x3A] = m[0x41:0x5B] = m[0x61:0x7B] = True
    m[0x80:] = True
    return m


SPACED = _rule(_non_space(), lower=False)  # [^\x20\x09-\x0D]+
SPACED_LOWER = _rule(_non_space(), lower=True)  # the same, A-Z hashed as a-z
ALNUM_LOWER = _rule(_alphanumeric(), lower=True)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of A-Z lower-cased

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, PIECE + 1)
        base = int(_BASE)
        inv = pow(base, -1, 1 << 64)
        for name, x in (("_pow", base), ("_inv", inv)):
            a = np.full(size, x, dtype=np.uint64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _pow, _inv


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``data``, hashes, and the words of each text."""

    data: np.ndarray  # uint8, the texts one after another
    bounds: np.ndarray  # int64, byte offsets of the texts (one more than texts)
    start: np.ndarray  # int64, byte offset of each word
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # int64, index of each text's first word (one more than texts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one text."""
        total = len(self.hash)
        out = np.zeros(total, dtype=np.uint64)
        ok = np.zeros(total, dtype=bool)
        if total >= n:
            acc = self.hash[: total - n + 1].copy()
            for j in range(1, n):
                acc *= _STEP
                acc += self.hash[j : total - n + 1 + j]
            out[: total - n + 1] = mix(acc)
            last = np.repeat(self.first[1:], self.counts)
            ok = np.arange(total) + n <= last
        return out, ok


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data, bounds


def slices(bounds: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes (one text at least)."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _cuts(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about PIECE bytes that end between words."""
    pos, end = int(bounds[0]), int(bounds[-1])
    while pos < end:
        cut = min(pos + PIECE, end)
        if cut < end:
            gap = np.flatnonzero(~is_word[data[pos:cut]][::-1][:4096])
            if len(gap):
                cut -= int(gap[0])
            else:
                edge = int(bounds[np.searchsorted(bounds, cut)])
                tail = np.flatnonzero(~is_word[data[cut:edge]])
                cut = cut + int(tail[0]) if len(tail) else edge
        yield pos, cut
        pos = cut


def split_words(data: np.ndarray, bounds: np.ndarray, rule: WordRule) -> Words:
    """Split the texts into words and hash each of them."""
    starts, ends, hashes = [], [], []
    is_edge = None
    for lo, hi in _cuts(data, bounds, rule.is_word):
        piece = data[lo:hi]
        word = rule.is_word[piece]
        is_edge = np.zeros(hi - lo + 1, dtype=bool)
        is_edge[0] = is_edge[-1] = True
        a, b = np.searchsorted(bounds, (lo, hi + 1))
        is_edge[bounds[a:b] - lo] = True
        s = word.copy()
        s[1:] &= ~word[:-1] | is_edge[1:-1]
        e = word.copy()
        e[:-1] &= ~word[1:] | is_edge[1:-1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        if not len(s):
            continue
        power, inverse = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(rule.code[piece] * power[: hi - lo], out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(h))
    empty = np.zeros(0, dtype=np.int64)
    start = np.concatenate(starts) if starts else empty
    end = np.concatenate(ends) if ends else empty
    h = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
    return Words(data, bounds, start, end, h, np.searchsorted(start, bounds))


def words_of(texts: list[str | None], rule: WordRule) -> Words:
    """Words of texts held in Python (small inputs: benchmark items, tests)."""
    return split_words(*text_buffers(pa.array(texts, type=pa.string())), rule)


def spread(hit: np.ndarray, n: int) -> np.ndarray:
    """Words covered by windows of n words that begin where ``hit`` is true."""
    step = np.zeros(len(hit) + n + 1, dtype=np.int32)
    at = np.flatnonzero(hit)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[: len(hit)]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of per-word (or per-byte) values over each text."""
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


class HashIndex:
    """Numbers distinct 64-bit hashes 0, 1, ... in the order they are added (open addressing)."""

    def __init__(self) -> None:
        self._resize(1 << 16)
        self.hashes = np.zeros(0, dtype=np.uint64)

    def __len__(self) -> int:
        return len(self.hashes)

    def _resize(self, slots: int) -> None:
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.number = np.full(slots, -1, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it is unknown."""
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        out = self.number[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = self.number[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[at[todo]] != h[todo])]
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.number[at] < 0
            self.keys[at[free]], self.number[at[free]] = h[free], number[free]
            lost = self.number[at] != number
            h, number, at = h[lost], number[lost], (at[lost] + 1) & mask

    def add(self, fresh: np.ndarray) -> None:
        """Add distinct hashes that are not known yet."""
        start = len(self.hashes)
        self.hashes = np.concatenate([self.hashes, fresh])
        if 2 * len(self.hashes) > len(self.keys):
            self._resize(2 << int(len(self.hashes)).bit_length())
            self._place(self.hashes, np.arange(len(self.hashes), dtype=np.int32))
        else:
            self._place(fresh, np.arange(start, len(self.hashes), dtype=np.int32))

    def number_all(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each hash, adding the unknown ones; and the positions in ``h`` at which the
        added ones first occur, in the order of their numbers."""
        out = self.find(h)
        spots = np.flatnonzero(out < 0)
        if len(spots):
            fresh, index = np.unique(h[spots], return_index=True)
            self.add(fresh)
            out[spots] = self.find(h[spots])
            spots = spots[index]
        return out, spots
