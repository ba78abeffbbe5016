"""Numpy helpers on packed texts: blocks, words, 64-bit hashes of byte ranges.

A block is a few whole texts (or pieces of one) laid end to end as bytes, so
that one numpy call serves all of them and memory stays bounded whatever the
Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 20

# The white space every contract of this package names: [\x20\x09-\x0D].
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_CHARS = " \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]] if len(ends) else data[:0], ends - (ends[0] if len(ends) else 0)


def runs_of_texts(ends: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes, one text at least."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def power_table(n: int, odd: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = pow(odd, -1, 1 << 64)
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = _U(odd), _U(inverse)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = max(BLOCK_BYTES + 4096, 1 << (n + 1).bit_length())
    known = _TABLES.get(seed)
    if known is None or len(known[0]) < n + 1:
        codes = mix(np.arange(1, 257, dtype=np.uint64) * _ODD + _U(seed))
        odd = int(mix(np.array([seed + 77], np.uint64))[0]) | 1
        known = (*power_table(size, odd), codes)
        _TABLES[seed] = known
        if n + 1 > BLOCK_BYTES * 4:  # a giant text: do not keep its tables
            _TABLES.pop(seed)
    return known


class RangeHash:
    """Hashes of any byte ranges of one block, two array reads each."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self.down, codes = _tables(len(data), seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(value ^ (np.asarray(ends - starts).astype(np.uint64) * _ODD))


def long_hash(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """What RangeHash gives for all of ``data``, block by block."""
    up, _, codes = _tables(BLOCK_BYTES, seed)
    value, power, word = 0, 1, (1 << 64) - 1
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES]
        value = (value + int((codes[block] * up[: len(block)]).sum()) * power) & word
        power = power * int(up[len(block)]) & word
    return mix(np.array([value ^ (len(data) * int(_ODD) & word)], np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and how many each text has.

    ``ends`` are the n + 1 offsets of the texts; words never cross them.
    """
    n = len(data)
    inside = ~_IS_SPACE[data]
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(ends) - 1, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, ends))
    return starts, stops, counts


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours: len(hashes) - width + 1 values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out = mix(out * _ODD + hashes[i : i + n])
    return out


def as_long(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed longs that Spark has."""
    return values.view(np.int64)


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as int64 (callers have removed null ids)."""
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    if not len(flags):
        none = np.empty(0, np.int64)
        return none, none
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal disjoint ranges, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]
