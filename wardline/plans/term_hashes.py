"""Hash buckets of words and word pairs, on batches of texts as arrays.

A term's bucket comes from the first four bytes of its MD5, as SQL says it with
``md5``.  Hashing terms one string at a time was half of the time of a training;
here the rounds run over thousands of terms at once.  Words are cut by the JVM, which
knows what lower case, a letter and a number are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import text as tx

# Bytes of text that are worked on at a time, and terms that are hashed at a time: arrays long enough to pay for a call, short enough for the cache.
PART = 1 << 20
CHUNK = 1 << 15
SPACE = 0x20
# A term of at most so many bytes is one block of MD5; the turns and constants of its 64 steps, and its start.
ONE_BLOCK = 55
TURNS = [n for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for n in row]
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def spaced_words(c: Column) -> Column:
    """The words of a text in lower case, one space behind the last and between any two; null for a null text."""
    return F.concat(F.regexp_replace(F.lower(c), f"[^{tx.WORD_CHARS}]+", " "), F.lit(" "))


def bucket_parts(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of some rows after each other: the first, their number, and of each of their terms the row (from the first) and the bucket.

    ``column`` holds ``spaced_words``, or arrays of buckets, which are taken as they are.
    """
    if isinstance(column, pa.ListArray):
        ends = column.offsets.to_numpy()
        given = column.values.to_numpy(zero_copy_only=False)
        for first, last in _cuts(ends, PART >> 2):
            yield first, last - first, np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), given[ends[first] : ends[last]]
        return
    column = column.cast(pa.large_binary())
    _, places, content = column.buffers()
    ends = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content else np.empty(0, np.uint8)
    for first, last in _cuts(ends, PART):
        part = data[ends[first] : ends[last]]
        owner, starts, sizes = _terms(part, ends[first : last + 1] - ends[first])
        yield first, last - first, owner, (md5_heads(part, starts, sizes) % buckets).astype(np.int32)


def _cuts(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size``, or of one row that is larger."""
    first, rows = 0, len(ends) - 1
    while first < rows:
        last = max(first + 1, min(int(np.searchsorted(ends, ends[first] + size, side="right")) - 1, rows))
        yield first, last
        first = last


def _terms(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and size of each word and, behind them, of each pair of neighbouring words: one stretch, as they are spaced."""
    stops = np.flatnonzero(data == SPACE)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    real = stops > starts
    starts, stops = starts[real], stops[real]
    owner = np.searchsorted(ends, starts, side="right") - 1
    near = np.flatnonzero(owner[1:] == owner[:-1])
    return np.concatenate([owner, owner[near]]), np.concatenate([starts, starts[near]]), np.concatenate([stops - starts, stops[near + 1] - starts[near]])


def md5_heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of each stretch of bytes, as a number, the first byte highest."""
    out = np.empty(len(starts), np.uint32)
    # Stretches of like sizes are hashed together: they take as many words of a block.
    order = np.argsort(np.minimum(sizes, ONE_BLOCK + 1).astype(np.uint8), kind="stable")
    short = int(np.count_nonzero(sizes <= ONE_BLOCK))
    # The four bytes from each place on.
    four = np.ndarray((len(data) + 1,), "<u4", np.concatenate([data, np.zeros(4, np.uint8)]), strides=(1,)).copy()
    for at in range(0, short, CHUNK):
        some = order[at : min(at + CHUNK, short)]
        out[some] = _one_block(four, starts[some], sizes[some])
    for i in order[short:].tolist():
        out[i] = int.from_bytes(hashlib.md5(data[starts[i] : starts[i] + sizes[i]].tobytes(), usedforsecurity=False).digest()[:4], "big")
    return out


def _one_block(four: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The heads of stretches of at most ``ONE_BLOCK`` bytes, the longest last."""
    top = int(sizes[-1]) // 4
    words = np.zeros((top + 1, len(starts)), np.uint32)
    for i in range(top):
        m = np.searchsorted(sizes, 4 * (i + 1))  # those before have no further four bytes
        words[i, m:] = four[starts[m:] + 4 * i]
    whole, rest = sizes >> 2, sizes & 3
    tail = four[starts + 4 * whole] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[rest]
    words[whole, np.arange(len(starts))] = tail | np.array([0x80, 0x8000, 0x800000, 0x80000000], np.uint32)[rest]
    bits = (sizes << 3).astype(np.uint32)
    a, b, c, d = (np.full(len(starts), x, np.uint32) for x in START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, SINES[i], out=f)
        if at <= top or at == 14:  # the others are nought
            np.add(f, words[at] if at <= top else bits, out=f)
        np.left_shift(f, np.uint32(TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(START[0])).byteswap()
