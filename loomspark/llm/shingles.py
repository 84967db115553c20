"""Shingle sets of whole texts, as arrays over an Arrow batch.

A word is any run of characters other than the ASCII blanks, A-Z lower-cased. A text's set
holds the distinct shingles of five consecutive words; a shorter text's whole word sequence
is its only shingle, and a text without words has none. A shingle is known by 52 bits of a
hash, which leaves room for the row number beside it in one sortable number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from loomspark.llm.textops import NONBLANK_CLASS, mix64, row_blocks, string_buffers, word_hashes, words

SIZE = 5
ROW_BITS = 12
HASH_BITS = 64 - ROW_BITS
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
BLOCK_BYTES = 4 << 20
#: Least bits of a signature; each has 4 to 8 for a shingle.
LEAST_BITS = 512
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass
class Sets:
    """The sets of rows a to b of a batch: hashes sorted within each row."""

    first: int
    hashes: np.ndarray
    rows: np.ndarray
    size: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def shingle_sets(column: pa.Array) -> Iterator[Sets]:
    raw, offsets = string_buffers(column)
    for a, b in row_blocks(offsets, BLOCK_BYTES, 1 << ROW_BITS):
        part = raw[offsets[a] : offsets[b]]
        starts, ends, rows = words(part, offsets[a : b + 1] - offsets[a], NONBLANK_CLASS)
        hashes = word_hashes(part, starts, ends)
        n = b - a
        count = np.bincount(rows, minlength=n)
        with np.errstate(over="ignore"):
            whole = len(hashes) - SIZE + 1
            if whole > 0:
                joined = np.zeros(whole, dtype=np.uint64)
                for k in range(SIZE):
                    joined += mix64(hashes[k : k + whole] * _STEPS[k])
                inside = rows[: whole] == rows[SIZE - 1 :]
                keys, owner = mix64(joined[inside]), rows[:whole][inside]
            else:
                keys, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            short = np.flatnonzero((count > 0) & (count < SIZE))
            if len(short):
                first = np.cumsum(count) - count
                sums = np.zeros(len(short), dtype=np.uint64)
                for k in range(SIZE - 1):
                    has = count[short] > k
                    sums[has] += mix64(hashes[first[short[has]] + k] * _STEPS[k])
                keys = np.concatenate([keys, mix64(sums ^ count[short].astype(np.uint64))])
                owner = np.concatenate([owner, short])
        packed = np.sort(owner.astype(np.uint64) << np.uint64(HASH_BITS) | keys & HASH_MASK)
        if len(packed):
            packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
        owner = (packed >> np.uint64(HASH_BITS)).astype(np.int64)
        yield Sets(a, packed & HASH_MASK, owner, np.bincount(owner, minlength=n).astype(np.int64))


def identities(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for a row's set, whatever its order."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets.hashes ^ np.uint64(salt)))])
            out.append((sums[sets.start + sets.size] - sums[sets.start]).view(np.int64))
    return out[0], out[1]


def signature_bits(size: np.ndarray) -> np.ndarray:
    """The power of two that is at least four times the size."""
    return np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64))


def bitmaps(hashes: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """For each row a bitmap of as many bits as bits says: one bit for each hash, by its low bits."""
    start = np.concatenate([[0], np.cumsum(bits)])
    flat = np.zeros(int(start[-1]), dtype=bool)
    flat[start[rows] + (hashes & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed, at = np.packbits(flat), start >> 3
    return [packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def signatures(sets: Sets) -> list[bytes]:
    """A bitmap of each row's set, its width by the set's size."""
    return bitmaps(sets.hashes, sets.rows, signature_bits(sets.size))


def fold(bitmap: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of uint64) of half the width: both halves OR-combined, as fewer low bits of the same hashes give."""
    half = bitmap.shape[1] // 2
    return bitmap[:, :half] | bitmap[:, half:]


def prefix_length(size: np.ndarray) -> np.ndarray:
    """How many shingles of a set, in any order common to all sets, meet one of any set it links with."""
    return np.where(size > 0, size - -(-size * 4 // 5) + 1, 0)
