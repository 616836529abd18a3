"""Words of Arrow text columns as numpy arrays.

Texts stay the bytes of Arrow's buffers: no Python string is made for a word.
A word is hashed to 64 bits in lanes of eight bytes, each mixed before the next is added, so that no
algebraic structure of a word makes it collide.  Where equal hashes must mean equal words, ``Words.same`` compares the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of more bytes are hashed by their BLAKE2 digest.
_LONG = 256
#: What of a lane of eight bytes belongs to a word with so many bytes left.
_PART = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (a longer text is a slice of its own)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    _, offsets = column_bytes(col)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of all rows of a column, in order.

    ``hash`` has 64 bits a word; ``first`` the number of words before each row (and of all at the end);
    ``start`` and ``end`` the places in ``data``.
    """

    def __init__(self, col: pa.Array, lower: bool = False, classes: np.ndarray | None = None):
        data, self.offsets = column_bytes(col)
        self.raw = data
        self.data = LOWER[data] if lower else data
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        if classes is None:
            solid = ~SPACE[data]
            before = np.empty(n, bool)
            before[:1] = False
            before[1:] = solid[:-1]
            before[begins[:n]] = False
            self.start = np.flatnonzero(solid & ~before)
            after = np.empty(n, bool)
            after[-1:] = False
            after[:-1] = solid[1:]
            after[begins[1:]] = False
            self.end = np.flatnonzero(solid & ~after) + 1
        else:  # a border also lies between neighbouring bytes of classes 1 and 2
            kind = classes[data]
            solid = kind != 0
            turn = np.zeros(n + 1, bool)
            turn[1:n] = (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0) & (kind[1:] != 3) & (kind[:-1] != 3)
            turn |= begins
            before = np.zeros(n, bool)
            before[1:] = solid[:-1]
            self.start = np.flatnonzero(solid & (~before | turn[:n]))
            after = np.zeros(n, bool)
            after[:-1] = solid[1:]
            self.end = np.flatnonzero(solid & (~after | turn[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hash()

    def __len__(self) -> int:
        return len(self.start)

    def _lanes(self) -> np.ndarray:
        """The eight bytes that begin at each place."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))

    def _hash(self) -> np.ndarray:
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
        lanes = self._lanes()
        open_, at, left = slice(None), self.start, size
        number = 0
        while len(at):
            lane = lanes[at] & _PART[np.minimum(left, 8)]
            number += 1
            out[open_] = mix(mix(out[open_] + lane) ^ (lane * np.uint64(0xC2B2AE3D27D4EB4F + 2 * number)))
            more = np.flatnonzero((left > 8) & (size[open_] <= _LONG))
            open_ = np.arange(len(size))[open_][more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def same(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether words (by number) are equal byte by byte, pair by pair."""
        size = (self.end - self.start)[one]
        out = size == (self.end - self.start)[other]
        lanes = self._lanes()
        open_ = np.flatnonzero(out)
        a, b, left = self.start[one[open_]], self.start[other[open_]], size[open_]
        while len(open_):
            part = _PART[np.minimum(left, 8)]
            equal = lanes[a] & part == lanes[b] & part
            out[open_[~equal]] = False
            more = np.flatnonzero(equal & (left > 8))
            open_, a, b, left = open_[more], a[more] + 8, b[more] + 8, left[more] - 8
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` neighbouring words; runs across rows are the caller's to leave out.

    Runs of 2, 4, 8, ... words are mixed from two of half their length, and the runs of k from those that add up to k.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    out, have, run, size = None, 0, mix(words), 1
    while True:
        if k & size:
            out = run[: len(words) - size + 1] if out is None else mix(out[: len(words) - have - size + 1] * odd + run[have : len(words) - size + 1])
            have += size
        if have == k:
            return mix(out[:n] + np.uint64(k))
        run = mix(run[: len(run) - size] * odd + run[size:] + np.uint64(size))
        size *= 2


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingles of each row, joined, and their offsets; with fewer words, all words are one shingle."""
    counts = words.counts()
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    runs = rolling(words.hash, k)
    owner = np.repeat(np.arange(len(counts)), sizes)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(words.first[:-1], sizes) + inner
    full = counts[owner] >= k
    values = np.empty(len(owner), np.uint64)
    values[full] = runs[place[full]]
    before = np.cumsum(sizes) - sizes
    for i in np.flatnonzero((counts > 0) & (counts < k)):  # at most k - 1 words each
        part = words.hash[words.first[i] : words.first[i + 1]]
        values[before[i]] = rolling(part, len(part))[0]
    for a, b in zip(before.tolist(), (before + sizes).tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and addends of ``n`` universal hash permutations of 32 bits."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minhash(values: np.ndarray, offsets: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """MinHash signatures (rows by ``n``, 32 bits); a row without shingles has the largest value throughout."""
    factors, addends = permutations(n, seed)
    rows = len(offsets) - 1
    out = np.full((rows, n), np.uint32(0xFFFFFFFF), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(offsets[full], offsets[full[at]] + (1 << 16), "left")))
        own = full[at:to]
        low, high = offsets[own[0]], offsets[own[-1] + 1]
        x = (values[low:high] >> np.uint64(32)).astype(np.uint32)
        cuts = offsets[own] - low
        y = np.empty_like(x)
        for j in range(n):
            np.multiply(x, factors[j], out=y)
            np.add(y, addends[j], out=y)
            out[own, j] = np.minimum.reduceat(y, cuts)
        at = to
    return out
