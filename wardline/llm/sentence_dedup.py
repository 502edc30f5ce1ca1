"""Removal of passages that repeat across the corpus, sentence by sentence.

A sentence ends with a word that ends in ``.``, ``!``, ``?`` or their wide forms, or
with a line break.  Sentences are cut further, before the word with the smallest
hash of every ``NEAR`` words in a row, so that a piece has at most ``NEAR`` words and
a place well inside a passage is cut, or not, whatever surrounds the passage.

From every piece a run goes on until it has ``ENOUGH`` words; one that begins with a
sentence ends earlier, with its ``RUN``-th sentence, or the first one after that by
which it has ``LEAST`` words.  One more run is the end of the text: its last pieces
with ``ENOUGH`` words together, or all of it.  Runs are hashed; of equal runs only
the first, by doc_id and place, stays, and a piece goes when any other run
covers it.  Any 50 words in a row hold a run, and its pieces lack at most ``2 *
NEAR`` words at either end of what is repeated.

Letter case (A-Z) and white space do not matter.  In scripts without spaces
(Chinese, Japanese, Thai, Lao, Burmese, Khmer) a character is a word.

Copies of a run inside one batch of documents are recognised before the
shuffle, so a run that very many documents share is a few rows.

Nulls and edge cases: a null, empty or blank text has no sentence and stays as
it is.  A text of fewer than ``LEAST`` words has no run.  Rows with a null
doc_id stay as they are and are compared with nothing; rows that share a doc_id
must have one text and are read as one document, so both lose the same.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardline.llm.blocks import IS_SPACE, Block, blocks, longs, merged, mix, range_fingerprints, without

RUN = 3
LEAST = 16
NEAR = 6
ENOUGH = 24

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_WIDE_ENDS = [int.from_bytes(c.encode()) for c in "。！？"]


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``block.words()``, with every character of a script without spaces as a word."""
    starts, ends, first = block.words()
    begin = np.flatnonzero(block.data & 0xC0 != 0x80)
    lead, then = block.data[begin], np.append(block.data, 0)[begin + 1]
    own = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xEF) & (then >= 0xBC) & (then <= 0xBE) | (lead == 0xF0) & (then >= 0xA0)
    own |= (lead == 0xE0) & (then >= 0xB8) & (then <= 0xBB)
    own |= (lead == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then >= 0x9E) & (then <= 0x9F))
    if not own.any():
        return starts, ends, first
    after = np.append(False, own[:-1])
    more = np.union1d(starts, begin[(own | after) & ~IS_SPACE[lead]])
    ends = np.minimum(ends[np.searchsorted(starts, more, side="right") - 1], np.append(more[1:], len(block.data)))
    return more, ends, np.searchsorted(more, block.offsets)


def _sentences(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, the first word of each piece, whether a sentence begins there, the first piece of each text (with the total at the end)."""
    starts, ends, first = _words(block)
    if not len(starts):
        return starts, ends, starts, np.zeros(0, bool), np.zeros(len(first), np.int64)
    lines = np.concatenate(([0], np.cumsum(block.data == 10)))
    last = _ENDS[block.data[ends - 1]]
    three = np.flatnonzero(ends - starts == 3)
    code = block.data[starts[three][:, None] + np.arange(3)].astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
    last[three] |= np.isin(code, _WIDE_ENDS)
    new = np.ones(len(starts), bool)
    new[1:] = last[:-1] | (lines[starts[1:]] > lines[ends[:-1]])
    new[first[:-1][first[:-1] < len(starts)]] = True
    cut = new.copy()
    if len(starts) >= NEAR:
        near = np.lib.stride_tricks.sliding_window_view(block.fingerprints(starts, ends), NEAR)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        within = np.flatnonzero(owner[: len(near)] == owner[NEAR - 1 :])
        cut[within + near[within].argmin(axis=1)] = True
    pieces = np.flatnonzero(cut)
    return starts, ends, pieces, new[pieces], np.searchsorted(pieces, first)


def _ranges(pieces: np.ndarray, whole: np.ndarray, first: np.ndarray, words: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First piece, end and text of each run, text by text; of a text the run at its end is the last one."""
    word = np.append(pieces, words)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    each, limit = np.arange(len(pieces)), first[1:][owner]
    stop = np.searchsorted(word, pieces + ENOUGH)
    # Sentences by number: the run-th one after the piece, or the first one that far off.
    opens = np.append(np.flatnonzero(whole), len(pieces))
    number = np.maximum(np.cumsum(whole) - 1 + run, np.searchsorted(word[opens], pieces + LEAST))
    closed = np.append(opens, np.full(run, len(word)))[number]
    stop = np.where(whole & (closed <= limit), np.minimum(stop, closed), stop)
    inside = stop <= limit
    texts = np.flatnonzero(word[first[1:]] - word[first[:-1]] >= LEAST)
    tail = np.searchsorted(word, word[first[1:]][texts] - ENOUGH, side="right") - 1
    tail = np.maximum(tail, first[:-1][texts])
    more = ~inside[tail] | (stop[tail] < limit[tail])
    texts, tail = texts[more], tail[more]
    begin, stop = np.append(each[inside], tail), np.append(stop[inside], first[1:][texts])
    owner = np.append(owner[inside], texts)
    order = np.argsort(owner, kind="stable")
    return begin[order], stop[order], owner[order]


def _runs(run: int) -> Callable:
    """Rows (run, doc_id, at), ``at`` the number of the run in its text.

    It is inverted if an earlier run of the batch is equal; such a run gets a hash of its own.
    """

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = []
            for block in blocks(batch.column("text"), lower=True):
                starts, ends, pieces, whole, first = _sentences(block)
                begin, stop, doc = _ranges(pieces, whole, first, len(starts), run)
                at = np.arange(len(doc)) - np.searchsorted(doc, doc)
                edges = np.append(pieces, len(starts))
                words = range_fingerprints(block.fingerprints(starts, ends), edges[begin], edges[stop])
                parts.append((words, ids[doc + block.first], at))
            if not parts:
                continue
            words, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, doc, words))
            words, doc, at = words[order], doc[order], at[order]
            new, same = np.ones(len(words), bool), words[1:] == words[:-1]
            new[1:] = ~same | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])  # repeated rows give equal runs
            again = np.append(False, same)[: len(new)][new]
            words, doc, at = words[new], doc[new], at[new]
            words = np.where(again, mix(words ^ mix(doc.astype(np.uint64))), words)
            columns = [longs(words), longs(doc), pa.array(np.where(again, ~at, at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "doc_id", "at"])

    return work


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, places): numbers of the runs that are not the first of their kind."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    runs = docs.mapInArrow(_runs(run), "run long, doc_id long, at int")
    place = F.struct("doc_id", "at")
    runs = runs.withColumn("lead", F.min(place).over(Window.partitionBy("run"))).filter((F.col("at") < 0) | (F.col("lead") != place))
    at = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    return runs.groupBy("doc_id").agg(F.collect_list(at).alias("places"))


def _removed(schema: T.StructType, text: str, places: str, added: tuple[str, str], run: int) -> Callable:
    """Texts without the pieces of the given runs; numbers of pieces and of removed ones are added."""
    arrow = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            texts, gone = batch.column(text).to_pylist(), batch.column(places)
            counts, removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for block in blocks(batch.column(text), lower=True):
                starts, _, pieces, whole, first = _sentences(block)
                counts[block.first : block.last] = np.diff(first)
                ranges = _ranges(pieces, whole, first, len(starts), run)
                owned = np.searchsorted(ranges[2], np.arange(block.last - block.first))
                for i in range(block.first, block.last):
                    if not gone[i].is_valid:
                        continue
                    k = i - block.first
                    at = owned[k] + np.array(gone[i].as_py(), np.int64)
                    low, high = merged(ranges[0][at] - first[k], ranges[1][at] - first[k])
                    removed[i] = (high - low).sum()
                    # A piece reaches to the next one; the last to the end of the text.
                    begin = starts[pieces[first[k] : first[k + 1]]] - block.offsets[k]
                    begin = np.append(begin, block.offsets[k + 1] - block.offsets[k])
                    texts[i] = without(texts[i].encode(), begin[low], begin[high]).decode()
            columns = []
            for f in arrow:
                if f.name == text:
                    columns.append(pa.array(texts, f.type))
                elif f.name in added:
                    columns.append(pa.array((counts, removed)[added.index(f.name)]))
                else:
                    columns.append(batch.column(f.name).cast(f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return work


def sentence_dedup(docs: DataFrame, run: int = RUN, counts: bool = False) -> DataFrame:
    """The documents without repeated sentences; ``n_chars``, if there is one, follows the new text.

    With ``counts`` the columns n_sentences and n_removed, numbers of pieces, are added (or replaced).
    """
    places, added = "places of repeated runs", ("n_sentences", "n_removed") if counts else ("", "")
    while places.lower() in {c.lower() for c in docs.columns}:
        places += "_"
    gone = repeated_runs(docs, run).withColumnRenamed("places", places)
    docs = docs.drop(*added) if counts else docs
    out = T.StructType([f for f in docs.schema] + [T.StructField(x, T.LongType()) for x in added if x])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    found = docs.join(gone, "doc_id", "left").mapInArrow(_removed(out, "text", places, added, run), out)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
