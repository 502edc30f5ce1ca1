"""Removal of repeated lines with a sharded minimal perfect hash.

A line's key is the line without white space (space, tab to carriage return) at
its ends, with A-Z in lower case.  A key of at least ``LEAST`` code points that
two or more documents hold loses all its lines except those in the smallest
doc_id that holds it.  Other lines stay, joined by line breaks.

1. Each batch of documents gives one row per distinct key hash (64 bits), with
   the smallest and the largest doc_id holding it; these are aggregated to one
   row per hash.  A key is repeated if the two ids differ.
2. The hashes are dealt into shards by their leading bits.  A shard gets a
   minimal perfect hash: a cascade of bit arrays, in each of which a key that
   meets no other sets its bit and the rest go on to the next; a key's number is
   the rank of its bit.  The number leads to a fingerprint of 16 bits and to the
   count of documents (which stops at two); repeated keys, ranked among
   themselves, also have the smallest doc_id.
3. Documents send the hashes of their lines to the shard, where they are looked
   up in the arrays; only hashes of lines to be dropped come back, by doc_id.

The number of shards follows the number of (document, line) pairs.  A shard with
far more than its share, as it holds a line of very many documents, has copies
that share its lookups; which shards those are (at most ``SPLITS``) goes to every
task.

Nulls and edge cases: a null or empty text is one empty line.  Rows with a null
doc_id stay whole and are compared with nothing.  Rows that share a doc_id are
one document: repeats among them stay, and each row loses the lines of keys that
a smaller doc_id holds.  Equality of keys is that of their 64-bit hashes.  Other
columns of the input are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.blocks import mix
from wardline.llm.scratch import settled

LEAST = 10
SPACE = b" \t\n\x0b\x0c\r"
# Lookups in a shard, and how many shards may be divided further.
PROBES = 32_768
SPLITS = 100_000
# Bits of a level for each key that reaches it.
ROOM = 2
LEVEL = np.uint64(0x9E3779B97F4A7C15)


def line_hashes(text: str | None, least: int = LEAST) -> Iterator[tuple[bytes, int | None]]:
    """Every line of a text with the hash of its key; None for a key of fewer than ``least`` code points."""
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(SPACE).lower()
        long = len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least
        yield line, xxhash.xxh3_64_intdigest(key) if long else None


def _batch_pairs(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, doc_id) of a batch, ordered."""
    hashes, docs = [], []
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        own = {h for _, h in line_hashes(text.as_py(), least) if h is not None}
        hashes += own
        docs += [doc] * len(own)
    hashes, docs = np.array(hashes, np.uint64), np.array(docs, np.int64)
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], docs[new]


def _held(least: int) -> Callable:
    """(hash, low, high, held): the smallest and the largest doc_id with a line, and the number of pairs."""

    def work(batches):
        for batch in batches:
            hashes, docs = _batch_pairs(batch, least)
            if len(hashes):
                lead = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                last = np.append(lead[1:], len(hashes))
                columns = [hashes[lead].view(np.int64), docs[lead], docs[last - 1], last - lead]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["hash", "low", "high", "held"])

    return work


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + LEVEL * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(48)).astype(np.uint16)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bits) of a minimal perfect hash of distinct 64-bit keys: a bit array per level, one behind the other."""
    sizes, parts = [], []
    while len(keys):
        size = ROOM * len(keys) + 1
        at = _level(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(alone)
        keys = keys[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, bool)


def numbers(sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's number under a perfect hash; -1 for one that meets no set bit."""
    found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    rank = np.cumsum(bits) - 1
    begin = 0
    for level, size in enumerate(sizes.tolist()):
        at = _level(keys[left], level, size) + begin
        hit = bits[at]
        found[left[hit]] = rank[at[hit]]
        left = left[~hit]
        begin += size
    return found


_INDEX = "shard long, sizes binary, bits binary, prints binary, counts binary, lows binary, probes long"


def _build(bits: int) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        keys = table.column("hash").to_numpy().view(np.uint64)
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        sizes, marks = perfect_hash(keys)
        place = np.argsort(numbers(sizes, marks, keys))
        again = (low != high)[place]
        row = {
            "shard": int(keys[0] >> np.uint64(64 - bits)),
            "sizes": sizes.tobytes(),
            "bits": np.packbits(marks).tobytes(),
            "prints": _fingerprint(keys[place]).tobytes(),
            "counts": np.packbits(again).tobytes(),
            "lows": low[place][again].tobytes(),
            "probes": int(table.column("held").to_numpy().sum()),
        }
        kinds = [("shard", pa.int64()), *((c, pa.binary()) for c in ("sizes", "bits", "prints", "counts", "lows")), ("probes", pa.int64())]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds))

    return work


class Arrays:
    """A shard's arrays, as read back."""

    def __init__(self, row: dict):
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(self.sizes.sum())).astype(bool)
        self.prints = np.frombuffer(row["prints"], np.uint16)
        self.again = np.unpackbits(np.frombuffer(row["counts"], np.uint8), count=len(self.prints)).astype(bool)
        self.lows = np.frombuffer(row["lows"], np.int64)

    def firsts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is in two documents or more, and the smallest doc_id holding it (0 where not)."""
        number = numbers(self.sizes, self.bits, keys)
        known = number >= 0
        known[known] = self.prints[number[known]] == _fingerprint(keys[known])
        again = np.zeros(len(keys), bool)
        again[known] = self.again[number[known]]
        first = np.zeros(len(keys), np.int64)
        first[again] = self.lows[(np.cumsum(self.again) - 1)[number[again]]]
        return again, first


def _probes(least: int, bits: int, split: dict[int, int]) -> Callable:
    """(shard, part, hash, doc_id) of every line of a document once."""
    shards = np.array(sorted(split), np.uint64)
    copies = np.array([split[s] for s in sorted(split)], np.uint64)

    def work(batches):
        for batch in batches:
            hashes, docs = _batch_pairs(batch, least)
            shard = hashes >> np.uint64(64 - bits)
            part = np.zeros(len(hashes), np.int64)
            if len(shards):
                at = np.minimum(np.searchsorted(shards, shard), len(shards) - 1)
                mine = shards[at] == shard
                part[mine] = (mix(docs.view(np.uint64)[mine]) % copies[at[mine]]).astype(np.int64)
            columns = [shard.astype(np.int64), part, hashes.view(np.int64), docs]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "part", "hash", "doc_id"])

    return work


def _look_up(index: pa.Table, probes: pa.Table) -> pa.Table:
    keys, docs = probes.column("hash").to_numpy().view(np.uint64), probes.column("doc_id").to_numpy()
    gone = np.zeros(len(keys), bool)
    for row in index.to_pylist():
        again, first = Arrays(row).firsts(keys)
        gone = again & (first != docs)
    return pa.table({"doc_id": docs[gone], "hash": keys[gone].view(np.int64)})


def line_index(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """The arrays of every shard, one row a shard, and the number of leading bits that name a shard."""
    held = docs.mapInArrow(_held(least), "hash long, low long, high long, held long")
    lines = held.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("held").alias("held"))
    lines = settled(lines, "lines")
    pairs = lines.agg(F.sum("held")).first()[0] or 0
    bits = max(6, (pairs // PROBES).bit_length())
    sharded = lines.withColumn("shard", F.shiftrightunsigned("hash", 64 - bits))
    return settled(sharded.groupBy("shard").applyInArrow(_build(bits), _INDEX), "line-index"), bits


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, gone): hashes of the lines that each document loses."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    index, bits = line_index(docs, least)
    limit = max(PROBES * 4, (index.agg(F.sum("probes")).first()[0] or 0) // SPLITS)
    # At most SPLITS rows: each holds more than that share of all pairs.
    heavy = index.filter(F.col("probes") > limit).select("shard", "probes").collect()
    split = {r["shard"]: -(-r["probes"] // limit) for r in heavy}
    asked = docs.mapInArrow(_probes(least, bits, split), "shard long, part long, hash long, doc_id long")
    parts = F.greatest(F.lit(1).cast("long"), F.when(F.col("probes") > limit, F.ceil(F.col("probes") / limit)).otherwise(1))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    found = copies.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(_look_up, "doc_id long, hash long")
    return found.groupBy("doc_id").agg(F.collect_list("hash").alias("gone"))


_KEPT = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"


def _kept(least: int, with_text: bool) -> Callable:
    def work(batches):
        for batch in batches:
            out = {"text": [], "n_lines": [], "n_dropped": [], "kept_sha256": []}
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                dropped = {h & 0xFFFFFFFFFFFFFFFF for h in gone.as_py() or ()}
                lines = list(line_hashes(text.as_py(), least))
                kept = [line for line, h in lines if h not in dropped]
                data = b"\n".join(kept)
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(data).hexdigest())
                out["text"].append(data.decode() if with_text else None)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [batch.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out])

    return work


def line_dedup(docs: DataFrame, least: int = LEAST, with_text: bool = True) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_sha256) of every row, without its repeated lines.

    ``n_lines`` counts before dropping; ``with_text=False`` leaves ``text`` out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.join(repeated_lines(docs, least), "doc_id", "left").mapInArrow(_kept(least, with_text), _KEPT)
    return found if with_text else found.drop("text")
