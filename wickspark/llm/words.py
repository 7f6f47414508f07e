"""Words of a column of texts, found in its Arrow buffer: where they start and end, and a 64-bit hash of each.

A word's hash is a sum over its eights of bytes, each mixed with its place and a seed, so hashes under two seeds have nothing to do
with each other, and no two words are bound to agree by the way they are built.

Texts are taken in slices of a few MB, so memory doesn't follow the number of rows in an Arrow batch; a text is never cut.
All word classes here are made of whole ASCII characters, so bytes of longer UTF-8 sequences never match a separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _space_class() -> np.ndarray:
    """Byte -> itself, or 0 for white space ([\\x20\\x09-\\x0D])."""
    out = np.arange(256, dtype=np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    return out


def _alnum_class() -> np.ndarray:
    """Byte -> itself, A-Z in lower case, or 0 for ASCII that is neither letter nor digit."""
    out = np.zeros(256, dtype=np.uint8)
    for a, b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[a : b + 1] = np.arange(a, b + 1)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def _lower_space_class() -> np.ndarray:
    out = _space_class()
    out[0x41:0x5B] += 0x20
    return out


SPACED, ALNUM, LOWER_SPACED = _space_class(), _alnum_class(), _lower_space_class()
#: NUL is a word character of the space classes, and stands for "none" in the tables above; its code is moved out of the way.
_NUL = {id(SPACED): True, id(LOWER_SPACED): True}


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: the first n bytes of eight
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
SEEDS = (1, 0xA0761D6478BD642F)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """Hash of the bytes start ... end - 1 of data, for each pair. None may be empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eights = (end - start + 7) >> 3
    first = np.cumsum(eights) - eights
    k = np.arange(first[-1] + eights[-1]) - np.repeat(first, eights)
    at = np.repeat(start, eights) + 8 * k
    every = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).data, strides=(1,))
    value = every[at] & _FIRST[np.minimum(np.repeat(end, eights) - at, 8)]
    step = mixed(np.arange(int(eights.max()), dtype=np.uint64) * MULTIPLIER + np.uint64(seed))
    return mixed(np.add.reduceat(mixed(value ^ step[k]), first) + (end - start).astype(np.uint64) * MULTIPLIER)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have


@dataclass
class Words:
    """Words of texts first ... first + count - 1 of a batch.

    Of text t: bytes at[t] ... at[t + 1] - 1 of data, words bounds[t] ... bounds[t + 1] - 1."""

    first: int
    count: int
    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    def text(self, t: int) -> slice:
        return slice(self.bounds[t], self.bounds[t + 1])

    def owner(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(self.count), np.diff(self.bounds))

    def joined(self, a: int, b: int) -> bytes:
        """Words a ... b - 1 as they stand, joined by one space."""
        data = self.data
        return b" ".join([data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes, one text at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words_of(column: pa.Array | pa.ChunkedArray, kind: np.ndarray, size: int = SLICE_BYTES) -> Iterator[Words]:
    """Slices of the column with their words. kind: SPACED, ALNUM or LOWER_SPACED. Offsets in Words count from the slice's data."""
    data, offsets = buffers(column)
    for a, b in slices(offsets, size):
        part = data[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        codes = kind[part]
        inside = codes != 0
        if id(kind) in _NUL:
            inside |= part == 0
        # a word starts where the byte before is a separator or another text's; ends likewise
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[at] = True
        before = np.concatenate(([False], inside))[: len(part)] if len(part) else np.zeros(0, bool)
        after = np.concatenate((inside[1:], [False])) if len(part) else np.zeros(0, bool)
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        bounds = np.searchsorted(start, at)
        text = codes if kind is not SPACED else part
        yield Words(a, b - a, text, at, start, end, bounds, word_hashes(text, start, end))


def grams(words: Words, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they all belong to its text (else the hash means nothing)."""
    w = len(words.hash)
    if w < n:
        return np.zeros(w, np.uint64), np.zeros(w, bool)
    up, down = powers(_BASE, w + 1), powers(_INVERSE, w + 1)
    total = np.zeros(w + 1, np.uint64)
    np.cumsum(words.hash * up[:w], out=total[1:])
    out = np.zeros(w, np.uint64)
    out[: w - n + 1] = mixed((total[n:] - total[: w - n + 1]) * down[: w - n + 1] + np.uint64(n + (salt << 32)))
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))
    return out, np.arange(w) + n <= last


def whole_hash(words: Words) -> np.ndarray:
    """Hash of all words of each text: each is mixed with its place."""
    n = np.diff(words.bounds)
    place = np.arange(len(words.hash)) - np.repeat(words.bounds[:-1], n)
    total = np.append(np.uint64(0), np.cumsum(mixed(words.hash ^ mixed((place + 1).astype(np.uint64) * MULTIPLIER))))
    return mixed(total[words.bounds[1:]] - total[words.bounds[:-1]] + n.astype(np.uint64))


def second(words: Words) -> Words:
    """The same words hashed anew from their bytes under another seed: with it, grams() and whole_hash() give the other half of a 128-bit hash."""
    return Words(words.first, words.count, words.data, words.at, words.start, words.end, words.bounds, word_hashes(words.data, words.start, words.end, SEEDS[1]))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
