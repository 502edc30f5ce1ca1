"""Vectorised byte work on Arrow string columns, used inside ``mapInArrow`` tasks.

A batch is cut into blocks of whole texts, about ``BLOCK`` bytes each, so that
memory does not follow the batch size.  A text longer than that is a block of
its own.  Substrings are compared by 64-bit polynomial fingerprints; two given
different strings agree with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

# Space and the five control characters from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    if len(_powers[0]) < size:
        size = max(size, BLOCK + 1)
        with np.errstate(over="ignore"):
            for i, base in enumerate((BASE, INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Texts ``first`` to ``last`` of a batch as one byte buffer; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    _sums: np.ndarray | None = field(default=None, repr=False)

    def fingerprints(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 64-bit number per substring [start, end)."""
        powers, inverses = _tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * inverses[starts])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each text's first word (with the total at the end)."""
        space = IS_SPACE[self.data]
        edge = np.ones(len(self.data) + 1, bool)
        edge[1:-1] = space[:-1]
        edge[self.offsets] = True
        starts = np.flatnonzero(edge[:-1] & ~space)
        edge[:-1] = space
        edge[-1] = True
        edge[self.offsets] = True
        ends = np.flatnonzero(edge[1:] & ~space) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def blocks(column: pa.Array, lower: bool = False) -> Iterator[Block]:
    """Blocks of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        own = data[offsets[first] : offsets[last]]
        yield Block(first, last, LOWER[own] if lower else own, offsets[first : last + 1] - offsets[first])
        first = last


def run_fingerprints(items: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every run of ``size`` consecutive items (by position in the block)."""
    count = len(items) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = (out + items[k : k + count]) * BASE
    return mix(out)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def range_fingerprints(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the item ranges [start, end)."""
    powers, inverses = _tables(len(items) + 1)
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * powers[: len(items)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by the ranges [start, end); touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(ends) else ends


def without(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes outside the given disjoint ascending ranges."""
    edges = [0, *(int(x) for pair in zip(starts, ends, strict=True) for x in pair), len(data)]
    return b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
