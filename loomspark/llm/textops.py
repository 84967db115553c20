"""Vectorised text primitives on Arrow string buffers.

All of them work on the UTF-8 bytes of a whole Arrow batch at once, so a task's
memory is bounded by the batch and no Python object exists per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and an odd base: the polynomial word hash.
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of letters, digits and every non-ASCII character.
ALNUM_CLASS = np.zeros(256, dtype=bool)
ALNUM_CLASS[0x30:0x3A] = ALNUM_CLASS[0x41:0x5B] = ALNUM_CLASS[0x61:0x7B] = ALNUM_CLASS[0x80:] = True
#: Words between blanks: everything but space and the five ASCII line and tab characters.
NONBLANK_CLASS = np.ones(256, dtype=bool)
NONBLANK_CLASS[[0x20, *range(0x09, 0x0E)]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
            done += step
    return out


_POWER = _powers(_BASE, _BLOCK + 1)
_INVERSE = _powers(_BASE_INVERSE, _BLOCK + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most_bytes: int, most_rows: int = 4096):
    """Row ranges of at most so many bytes (a longer single row stands alone)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), n, start + most_rows)
        yield start, end
        start = end


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words, in order; a word never spans rows."""
    inside = kind[raw]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    change = np.empty(len(raw) + 1, dtype=bool)
    change[0], change[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    edges = np.flatnonzero(change)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    if len(cuts):  # a row ends and the next begins inside a run: one edge more for the end, one for the start
        edges = np.sort(np.concatenate([edges, cuts, cuts]), kind="stable")
    starts, ends = edges[0::2], edges[1::2]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            upto = max(int(np.searchsorted(ends, base + _BLOCK, side="right")), at + 1)
            s, e = starts[at:upto] - base, ends[at:upto] - base
            size = int(e[-1])
            if size > _BLOCK:  # one word of more than a block
                out[at] = _long_hash(raw[base : base + size])
            else:
                sums = np.zeros(size + 1, dtype=np.uint64)
                np.cumsum(_BYTE_VALUE[_LOWER[raw[base : base + size]]] * _POWER[:size], out=sums[1:])
                out[at:upto] = (sums[e] - sums[s]) * _INVERSE[s]
            at = upto
        return mix64(out ^ mix64((ends - starts).astype(np.uint64)))


def _long_hash(word: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for i in range(0, len(word), _BLOCK):
        part = _BYTE_VALUE[_LOWER[word[i : i + _BLOCK]]]
        total += scale * int((part * _POWER[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(_BASE, len(part), 2**64) % 2**64
    return np.uint64(total % 2**64)
