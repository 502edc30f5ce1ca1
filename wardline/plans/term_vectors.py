"""Counts of hashed words, word pairs and character trigrams, as a stage of a Spark ML pipeline.

The stage counts what ``NGram`` and ``HashingTF`` count, to the same places: the
words and pairs of a tokenised text, and the trigrams that ``RegexTokenizer`` with
an empty pattern and ``NGram`` give.  There a character is a UTF-16 unit, half a
pair counts as ``?``, and a trigram is hashed as its characters with spaces between
them.  Those stages make several strings of every character and word of a text,
which is most of the time of a training; this one works on batches of texts as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCols, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Trigrams that are worked on at a time, so that the arrays stay in the processor's cache.
CHUNK = 1 << 15
# Texts whose vectors leave together.
ROWS = 256
# Fixed value: the seed of HashingTF.
SEED = 42
SPACE = 0x20


class TermVectors(Transformer, HasInputCols, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """A sparse vector of a text and its words, null if either is; these two columns (``inputCols``) do not go on.

    It has ``numFeatures`` places for words, as many for pairs of neighbouring words and as many for trigrams.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str | None = None, numFeatures: int | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = self.getNumFeatures()
        text, words = self.getInputCols()
        kept = [field for field in dataset.schema if field.name not in (text, words)]
        names = [*(field.name for field in kept), self.getOutputCol()]

        # The vectors are larger than the texts: they leave a few at a time, whatever the size of a batch.
        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    *columns, own, joined = batch.slice(at, ROWS).columns
                    yield pa.RecordBatch.from_arrays([*columns, term_vectors(own, joined, features)], names=names)

        # No word holds a space, so neighbouring words are one stretch of the joined ones.
        given = dataset.select(*(dataset[f"`{name}`"] for name in names[:-1]), text, F.array_join(words, " ").alias(words))
        return given.mapInArrow(counts, T.StructType([*kept, T.StructField(names[-1], VectorUDT())]))


def term_vectors(texts: pa.Array, words: pa.Array, features: int) -> pa.Array:
    """The vectors of some texts and their words, joined by spaces, in the layout of ``VectorUDT``."""
    found = [_counted(*part, features) for part in _parts(texts.to_pylist(), words.to_pylist())]
    sizes, indices, values = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, t) for t in "lid")
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    fields = {
        "type": pa.array(np.zeros(len(texts), np.int8)),
        "size": pa.array(np.full(len(texts), 3 * features, np.int32)),
        "indices": pa.ListArray.from_arrays(offsets, pa.array(indices)),
        "values": pa.ListArray.from_arrays(offsets, pa.array(values)),
    }
    missing = np.array(texts.is_null()) | np.array(words.is_null())
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields), mask=pa.array(missing, pa.bool_()))


def _parts(texts: list[str | None], words: list[str | None]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Texts in UTF-16 and their words in UTF-8, some at a time: about ``CHUNK`` units, or one longer text."""
    part, size = ([], []), 0
    for text, own in zip(texts, words, strict=True):
        part[0].append((text or "").encode("utf-16-le"))
        part[1].append((own or "").encode() + b" ")
        size += len(part[0][-1]) // 2
        if size >= CHUNK:
            yield part
            part, size = ([], []), 0
    if part[0]:
        yield part


def _counted(texts: list[bytes], words: list[bytes], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of its places; and the places and counts of all, ordered by text and place."""
    owners, places = [], []
    for at, (owner, place) in enumerate([*_words_and_pairs(words), _triples(texts)]):
        owners.append(owner)
        places.append(place % features + at * features)
    keys = np.sort(np.concatenate(owners) << 32 | np.concatenate(places))
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(first, append=len(keys)).astype(np.float64)
    found = keys[first]
    return np.bincount(found >> 32, minlength=len(texts)), (found & 0xFFFFFFFF).astype(np.int32), counts


def _words_and_pairs(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of words, then of pairs: the number of the text and the hash."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.flatnonzero(data == SPACE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    owner = np.searchsorted(np.cumsum([len(x) for x in words]), ends, side="right")
    real = ends > starts  # a text without words has an empty one
    starts, ends, owner = starts[real], ends[real], owner[real]
    yield owner, hashed_slices(data, starts, ends - starts)
    near = np.flatnonzero(owner[1:] == owner[:-1])
    yield owner[near], hashed_slices(data, starts[near], ends[near + 1] - starts[near])


def _triples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of trigrams: the number of the text and the hash."""
    units = np.frombuffer(b"".join(texts), "<u2")
    owner = np.repeat(np.arange(len(texts)), [len(x) // 2 for x in texts])
    places = [hashed_triples(units[i : i + CHUNK + 2]) for i in range(0, max(len(units) - 2, 0), CHUNK)]
    # No trigram reaches into the next text.
    inside = owner[2:] == owner[:-2]
    return owner[:-2][inside], (np.concatenate(places) if places else np.empty(0, np.int64))[inside]


def hashed_slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each stretch of bytes, as a signed number."""
    u = np.uint32
    order = np.argsort(-sizes, kind="stable")
    at, n = starts[order], sizes[order]
    # The four bytes from each place on.
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,)).copy()
    whole = n >> 2
    h = np.full(len(n), SEED, u)
    for i in range(int(whole[0]) if len(n) else 0):
        m = np.searchsorted(-whole, -i)  # longer ones come first
        h[:m] = _taken_up(h[:m], four[at[:m] + 4 * i])
    h ^= _mixed(four[at + 4 * whole] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], u)[n & 3])
    out = np.empty(len(n), np.int64)
    out[order] = _finished(h, n.astype(u))
    return out


@cache
def _utf8() -> tuple[np.ndarray, np.ndarray]:
    """Of each UTF-16 unit: its UTF-8 bytes as a number, the first byte lowest, and how many there are."""
    encoded = [chr(u if not 0xD800 <= u < 0xE000 else ord("?")).encode() for u in range(1 << 16)]
    return np.array([int.from_bytes(x, "little") for x in encoded], np.uint32), np.array([len(x) for x in encoded], np.uint8)


def hashed_triples(units: np.ndarray) -> np.ndarray:
    """The hash of each three units that follow each other with spaces between them, as a signed number."""
    if units.max() < 0x80:
        code = units.astype(np.uint32)
        return _spelled(code[:-2], code[1:-1], code[2:], 1, 1, 1)
    codes, sizes = _utf8()
    code, size = codes[units], sizes[units]
    shape = size[:-2] * 16 + size[1:-1] * 4 + size[2:]
    out = np.empty(len(shape), np.int64)
    for one in np.flatnonzero(np.bincount(shape)).tolist():
        at = np.flatnonzero(shape == one)
        out[at] = _spelled(code[at], code[at + 1], code[at + 2], one >> 4, one >> 2 & 3, one & 3)
    return out


def _spelled(a: np.ndarray, b: np.ndarray, c: np.ndarray, na: int, nb: int, nc: int) -> np.ndarray:
    """Hashes of trigrams whose characters take ``na``, ``nb`` and ``nc`` bytes."""
    u = np.uint32
    n = na + nb + nc + 2
    words, at = [u(0), u(0), u(0)], 0
    for part, size in ((a, na), (u(SPACE), 1), (b, nb), (u(SPACE), 1), (c, nc)):
        word, bit = divmod(8 * at, 32)
        words[word] = words[word] | part << u(bit)
        if bit + 8 * size > 32:
            words[word + 1] = words[word + 1] | part >> u(32 - bit)
        at += size
    h = np.full(len(a), SEED, u)
    for word in words[: n // 4]:
        h = _taken_up(h, word)
    if n % 4:
        h ^= _mixed(words[n // 4])
    return _finished(h, u(n))


# MurmurHash3, 32 bits: how four bytes are mixed and taken up, and the end.


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _mixed(k: np.ndarray) -> np.ndarray:
    return _turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _taken_up(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _turned(h ^ _mixed(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)


def _finished(h: np.ndarray, n: np.ndarray | np.uint32) -> np.ndarray:
    h = h ^ n
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(by)) * np.uint32(factor)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64)
