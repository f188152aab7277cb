"""Words of many texts as numpy arrays: positions, 64-bit hashes, hashes of word sequences.

Everything works on the UTF-8 bytes of an Arrow string column, in chunks of bounded size.
A word is a maximal run of bytes other than space and 0x09-0x0D, so the words are those of
the pattern [^\\x20\\x09-\\x0D]+. Hashes depend on the bytes alone: every task agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one chunk holds, unless a single text is longer.
CHUNK_BYTES = 500_000
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values, another one for each salt."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> U64(30))) * _MIX_A
    x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64), 77)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            table = np.full(size + 1, U64(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range, from prefix sums; the length takes part."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Some texts: their bytes, the byte range of each text, and the range of rows in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int
    last: int


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column in order; nulls are empty texts."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield Chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, last)
        first = last


@dataclass
class Words:
    """starts, ends: bytes of each word; bounds: the words of text k are bounds[k]:bounds[k + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def sequences(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words of one text, and their bounds by text."""
        counts = np.maximum(self.counts() - size + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        first = np.repeat(self.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
        return _range_hashes(self.hashes, first, first + size), bounds

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ranges of words."""
        return _range_hashes(self.hashes, starts, ends)


def words_of(chunk: Chunk, lower: bool = False) -> Words:
    """The words of a chunk; `lower` folds A-Z before hashing."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~IS_SPACE[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else True
    at = offsets[:-1][offsets[:-1] < n]
    begins[at] = inside[at]
    finishes = inside[:n] & ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finishes[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    bounds = np.searchsorted(starts, offsets)
    values = _BYTE_VALUES[LOWER[data] if lower else data]
    return Words(starts, ends, bounds, _range_hashes(values, starts, ends))


def lines_of(chunk: Chunk) -> Words:
    """The lines of a chunk that hold a word, in the same form."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    starts = starts[starts < n]
    stops = np.concatenate([cuts, [n]])
    ends = np.minimum(stops[np.searchsorted(cuts, starts)], offsets[np.searchsorted(offsets, starts, side="right")]) if len(starts) else starts
    solid = np.concatenate([[0], np.cumsum(~IS_SPACE[data])])
    keep = solid[ends] > solid[starts]
    starts, ends = starts[keep], ends[keep]
    return Words(starts, ends, np.searchsorted(starts, offsets), _range_hashes(_BYTE_VALUES[data], starts, ends))


def distinct_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of different hashes within each text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(bounds) - 1)
