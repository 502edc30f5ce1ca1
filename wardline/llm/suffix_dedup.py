"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
in the corpus: in a document with a smaller doc_id, or earlier in the same one.
Strings are judged on the input; matches never cross documents.

The suffixes of a corpus are not sorted whole.  Positions are put into buckets
by the q-gram they start with, and only buckets of two or more are refined:

1. Every window of ``length`` bytes belongs to the q-gram inside it with the
   smallest hash, so equal windows belong to equal q-grams.  Windows in a row
   with one q-gram form a run; a run is one row, about one for 31 bytes.
2. Runs are gathered by q-gram.  A run alone in its bucket is dropped.  The
   bucket is refined by the identity of the whole run: all windows of a run
   seen before are repeated.
3. Runs that share a q-gram but differ somewhere are refined window by window.
   In a task their bytes are one text; buckets of 25-grams, held as pointers for
   every position, are sorted by the pointer 25 bytes further on, which gives
   50-grams, and those by the pointer 50 bytes on.  A bucket of one is final at
   once.  Copies of a run in one batch of documents are told apart before the
   shuffle, and a q-gram with very many different runs is refined in several
   parts whose first windows are compared once more.

Nulls and edge cases: a null text is empty; a text shorter than ``length`` keeps
every byte.  Rows with a null doc_id are returned untouched and compared with
nothing.  Rows that share a doc_id must have one text; they are read as one
document.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.blocks import Block, blocks, longs, merged, mix, without
from wardline.llm.scratch import settled

LENGTH = 100
GRAM = 40
# Bits of a sort key that hold a position within a block.
PLACE = np.uint64(30)
# Bits of a run's place that hold its number of windows.
COUNT = 16
# Runs refined together in one task.
TOGETHER = 20_000


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def _block_runs(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows: document in the block, first window, number of windows, q-gram, identity."""
    size = len(block.data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none, none
    at = np.arange(size - gram + 1)
    grams = block.fingerprints(at, at + gram)
    keys = grams >> PLACE << PLACE | at.astype(np.uint64)
    anchor = (_lowest(keys, length - gram + 1) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    window = np.arange(size - length + 1)
    doc = np.repeat(np.arange(block.last - block.first), np.diff(block.offsets))[: len(window)]
    inside = window + length <= block.offsets[doc + 1]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    first, count = first[inside[first]], count[inside[first]]
    whole = block.fingerprints(first, first + count - 1 + length)
    return doc[first], first - block.offsets[doc[first]], count, grams[anchor[first]], whole


def _runs(length: int, gram: int) -> Callable:
    """Rows (gram, whole, doc_id, place), a run each.

    ``place`` is the first window and, in the low ``COUNT`` bits, the number of windows.
    It is inverted if an earlier run of the batch is equal; such a run needs no
    bucket, and gets one of its own.
    """

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = [(ids[doc + b.first], *rest) for b in blocks(batch.column("text")) for doc, *rest in [_block_runs(b, length, gram)]]
            if not parts:
                continue
            doc, first, count, grams, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((first, doc, whole))
            doc, first, count, grams, whole = (x[order] for x in (doc, first, count, grams, whole))
            new, same = np.ones(len(whole), bool), whole[1:] == whole[:-1]
            new[1:] = ~same | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])  # repeated rows give equal runs
            again = np.append(False, same)[: len(new)][new]
            doc, first, count, grams, whole = (x[new] for x in (doc, first, count, grams, whole))
            place = first << COUNT | count
            bucket = np.where(again, mix(grams ^ mix(doc.astype(np.uint64))), grams)
            columns = [longs(bucket), longs(whole), longs(doc), longs(np.where(again, ~place, place))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "whole", "doc_id", "place"])

    return work


def bucket_pointers(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal strings text[start:start + length], refined from buckets of a quarter of the length.

    ``length`` must be a multiple of four.  Strings alone in their bucket get a
    number of their own.
    """
    quarter = length // 4
    block = Block(0, 1, text, np.array([0, len(text)]))
    at = np.arange(len(text) - quarter + 1)
    _, pointer = np.unique(block.fingerprints(at, at + quarter), return_inverse=True)
    for offset in (quarter, 2 * quarter):
        # Sort on the pointer held ``offset`` further on; these pointers serve the next pass.
        later = np.full(len(pointer), -1, np.int64)
        later[: len(pointer) - offset] = pointer[offset:]
        shared = np.bincount(pointer)[pointer] > 1
        pairs = pointer[shared] * np.int64(len(text) + 2) + later[shared] + 1
        refined = np.arange(len(pointer), dtype=np.int64)
        _, lead, place = np.unique(pairs, return_index=True, return_inverse=True)
        refined[shared] = np.flatnonzero(shared)[lead][place]
        pointer = refined
    return pointer[starts]


def _ranges(doc: np.ndarray, window: np.ndarray) -> pd.DataFrame:
    """Rows (doc_id, low, high) of the consecutive windows of each document."""
    order = np.lexsort((window, doc))
    doc, window = doc[order], window[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(doc))[: len(low)] - 1
    return pd.DataFrame({"doc_id": doc[low], "low": window[low], "high": window[high]})


def _refine(length: int) -> Callable:
    """Repeated windows of the runs of a group; the first windows of a divided q-gram, which are not final, with their identity."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_id", "first"])
        count = rows["windows"].to_numpy()
        text = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
        base = np.concatenate(([0], np.cumsum([len(x) for x in rows["bytes"]])[:-1]))
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(base, count) + step
        doc, window = np.repeat(rows["doc_id"].to_numpy(), count), np.repeat(rows["first"].to_numpy(), count) + step
        pointer = bucket_pointers(text, starts, length)
        order = np.lexsort((window, doc, pointer))
        again = np.zeros(len(order), bool)
        again[order[1:]] = pointer[order[1:]] == pointer[order[:-1]]
        out = [_ranges(doc[again], window[again]).assign(whole=None)]
        open_ = ~again & np.repeat(rows["parts"].to_numpy() > 1, count)
        if open_.any():
            whole = Block(0, 1, text, np.array([0, len(text)])).fingerprints(starts[open_], starts[open_] + length).view(np.int64)
            out.append(pd.DataFrame({"doc_id": doc[open_], "low": window[open_], "high": window[open_], "whole": whole}))
        found = pd.concat(out)
        found["whole"] = found["whole"].astype("Int64")
        return found

    return work


def _packed(batches):
    """Texts as compressed bytes, for the shuffles."""
    pack = zstandard.ZstdCompressor(level=8).compress
    for batch in batches:
        packed = [pack((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _digest(length: int, last: bool) -> Callable:
    """Digests of documents whose repeated windows are all known; otherwise the text and the runs to refine."""

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = unpack(row["packed"])
                runs = row["runs"] or []
                ranges = [(x["low"], x["high"]) for x in runs if last or not x["open"]] + [(x["low"], x["high"]) for x in row.get("known") or []]
                opened = [] if last else [x for x in runs if x["open"]]
                low, high = np.array(ranges, np.int64).reshape(-1, 2).T
                starts, ends = merged(low, high + length)
                kept = None if opened else without(data, starts, ends)
                out.append(
                    {
                        "doc_id": row["doc_id"],
                        "n_bytes": len(data),
                        "n_removed": int((ends - starts).sum()),
                        "n_spans": len(starts),
                        "kept_sha256": None if opened else hashlib.sha256(kept).hexdigest(),
                        "kept": kept if last or not opened else None,
                        "packed": row["packed"] if opened else None,
                        "known": [{"low": a, "high": b} for a, b in ranges],
                        "opened": [
                            {"gram": x["gram"], "first": x["low"], "windows": x["high"] - x["low"] + 1, "bytes": data[x["low"] : x["high"] + length]}
                            for x in opened
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return work


_RANGE = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
_OPEN = pa.list_(pa.struct([("gram", pa.int64()), ("first", pa.int64()), ("windows", pa.int64()), ("bytes", pa.binary())]))
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    + [("kept", pa.binary()), ("packed", pa.binary()), ("known", _RANGE), ("opened", _OPEN)]
)
_SCHEMA = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, packed binary, "
    "known array<struct<low: long, high: long>>, opened array<struct<gram: long, first: long, windows: long, bytes: binary>>"
)


def _shared_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, runs): runs whose q-gram occurs elsewhere, each repeated as a whole or open."""
    runs = docs.mapInArrow(_runs(length, gram), "gram long, whole long, doc_id long, place long")
    bucket = Window.partitionBy("gram")
    where = F.struct("doc_id", "place")
    runs = runs.withColumn("held", F.count("*").over(bucket)).filter("place < 0 OR held > 1")
    runs = runs.withColumn("mixed", F.min("whole").over(bucket) < F.max("whole").over(bucket))
    runs = runs.withColumn("lead", F.min(where).over(Window.partitionBy("gram", "whole")) == where)
    runs = runs.withColumn("open", (F.col("place") >= 0) & F.col("lead")).filter("NOT open OR mixed")
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    low = F.shiftright(place, COUNT)
    run = F.struct("gram", low.alias("low"), (low + place.bitwiseAND((1 << COUNT) - 1) - 1).alias("high"), "open")
    return runs.groupBy("doc_id").agg(F.collect_set(run).alias("runs"))


def _refined(opened: DataFrame, length: int) -> DataFrame:
    """(doc_id, low, high): repeated windows of the open runs."""
    counts = opened.groupBy("gram").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    groups = max(1, opened.count() // TOGETHER * 4, opened.sparkSession.sparkContext.defaultParallelism)
    placed = opened.join(counts, "gram").withColumn("group", F.pmod(F.xxhash64("gram"), F.lit(groups)))
    placed = placed.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "first"), "parts")).otherwise(0))
    # A divided q-gram has groups of its own.
    placed = placed.withColumn("own", F.when(F.col("parts") > 1, F.col("gram")))
    found = placed.groupBy("group", "own", "part").applyInPandas(_refine(length), "doc_id long, low long, high long, whole long")
    found = settled(found, "refined")
    place = F.struct("doc_id", "low")
    firsts = found.filter("whole IS NOT NULL").withColumn("lead", F.min(place).over(Window.partitionBy("whole")))
    return found.filter("whole IS NULL").drop("whole").unionByName(firsts.filter(F.col("lead") != place).drop("lead", "whole"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every document without its repeated bytes.

    ``keep_bytes=False`` leaves out ``kept``, the remaining bytes.  ``length``
    must be a multiple of four and hold a q-gram.
    """
    if length % 4 or not 0 < gram <= length or length - gram >= 1 << COUNT:
        raise ValueError(f"length {length} does not go with q-grams of {gram} bytes")
    docs = docs.select("doc_id", "text")
    # Written by itself, so that the shuffle of all runs is gone before texts are shuffled.
    runs = settled(_shared_runs(docs.filter("doc_id IS NOT NULL"), length, gram), "runs")
    packed = docs.mapInArrow(_packed, "doc_id long, packed binary")
    first = packed.join(runs, "doc_id", "left").mapInArrow(_digest(length, False), _SCHEMA)
    first = settled(first if keep_bytes else first.drop("kept"), "digests")
    opened = first.select("doc_id", F.explode("opened").alias("run")).select("doc_id", "run.*")
    known = _refined(opened, length).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    rest = first.filter(F.size("opened") > 0).select("doc_id", "packed", "known").join(known, "doc_id", "left")
    rest = rest.mapInArrow(_digest(length, True), _SCHEMA)
    columns: list[str | Column] = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])]
    return first.filter(F.size("opened") == 0).select(columns).unionByName(rest.select(columns))
