"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens, and pieces fill
sequences.  Per sequence the longest piece left is taken, and a subset-sum
dynamic program over the lengths left, kept as the bits of one integer, finds
the combination that fills the rest best; it is removed, as often as its
lengths last.  The program needs only how many pieces there are of each length:
at most ``capacity`` numbers whatever the corpus.  The plan has at most one
pattern per length, since each use of a pattern exhausts a length.  Pieces are
then numbered within their length and look their place up in the plan.

Nulls and edge cases: a null or empty text is the end token alone.  Equal rows
are packed once each, in groups that a written number divides.  A null doc_id is kept.  An empty table gives no row.
Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.session import materialise

CAPACITY = 4096
END = 1
# Words a Python worker remembers the ids of, and text encoded at once.
WORDS = 400_000
TOGETHER = 1 << 20
# Rows of one length that are numbered together.
NUMBERED = 100_000

# A word of Latin letters and punctuation after it: the tokenizer lower-cases it and divides it there.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts from a tokenizer that never joins what white space divides; each different word is encoded once.

    The tokenizer must lower-case its input and divide letters from punctuation.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        known = self.known if len(self.known) + len(new) <= WORDS else dict(self.known)
        parts = {w: (m[1].lower(), m[2]) for w in new if (m := _PLAIN.fullmatch(w))}
        needed = (new - parts.keys()).union(*parts.values())
        self._learn(sorted(needed.difference(known)), known)
        known.update((w, known[a] + known[b]) for w, (a, b) in parts.items())
        return [b"".join([known[w] for w in words]) for words in split]

    def _learn(self, words: list[str], known: dict[str, bytes]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            found = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            begin = np.cumsum([0] + [len(w) + 1 for w in part])
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            edges = (np.searchsorted(starts, begin) * 4).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            known.update((w, ids[a:z]) for w, a, z in zip(part, edges, edges[1:], strict=False))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, keep_ids: bool) -> Callable:
    def work(batches):
        encode, end = encoder(path).encode, END.to_bytes(4, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                cut, size = at, 0
                while cut < len(texts) and (cut == at or size + len(texts[cut]) <= TOGETHER):
                    size += len(texts[cut])
                    cut += 1
                rows, ids = [], []
                for k, found in zip(range(at, cut), encode(texts[at:cut]), strict=True):
                    found += end
                    for piece, start in enumerate(range(0, len(found), 4 * capacity)):
                        own = found[start : start + 4 * capacity]
                        rows.append((k, piece, start // 4, len(own) // 4, zlib.crc32(own)))
                        ids.append(own if keep_ids else None)
                at = cut
                k, *columns = np.array(rows, np.int64).T
                columns = [pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(k)), *columns, pa.array(ids, pa.binary())], names=names)

    return work


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document's token ids and end token."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, keep_ids), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of which lengths fill ``room`` best; long ones are preferred."""
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reached))
            reached |= reached << length * times & (2 << room) - 1
            left, times = left - times, times * 2
        if reached >> room & 1:
            break
    target, chosen = reached.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + times
            target -= length * times
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, pieces per sequence, offset): where the pieces of a length go, by rank."""
    left = {length: n for length, n in counts.items() if n}
    ranks, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        pattern = fullest({x: n for x, n in rest.items() if n}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, ranks[length], sequence, n, offset))
            ranks[length] += n * times
            left[length] -= n * times
            offset += length * n
            if not left[length]:
                del left[length]
        sequence += times
    return sorted(rows)


def _place(rows: list[tuple[int, int, int, int, int]]) -> Callable:
    def work(batches):
        length, rank, sequence, per, offset = np.array(rows, np.int64).reshape(-1, 5).T
        keys = length << 48 | rank
        for batch in batches:
            own, at = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            k = np.searchsorted(keys, own << 48 | at, side="right") - 1
            behind = at - rank[k]
            found = [pa.array(sequence[k] + behind // per[k]), pa.array(offset[k] + behind % per[k] * own)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *found], names=["row", "sequence_id", "offset"])

    return work


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column length of 1 to capacity) with sequence_id and offset; all columns are kept.

    Columns of those two names are replaced.
    """
    kept = [f for f in pieces.schema if f.name.lower() not in ("sequence_id", "offset")]
    row = F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("row")
    # A written number tells rows apart, equal ones too, and stays if an executor is lost.
    rows = materialise(pieces.select(F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("number"), row), "pieces")
    salt = F.pmod(F.xxhash64("number"), F.lit(rows.count() // NUMBERED + 1))
    salted = rows.withColumn("salt", salt)
    counts = materialise(salted.groupBy("length", "salt").count(), "lengths")
    # At most ``capacity`` rows, whatever the size of the corpus.
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    order = Window.partitionBy("length", "salt").orderBy("number")
    ranked = salted.withColumn("place", F.row_number().over(order)).join(begin, ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("begin") + F.col("place") - 1).cast("long").alias("rank"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.mapInArrow(_place(plan(lengths, capacity)), schema)
    return placed.select(*(F.col(f"row.`{f.name}`") for f in kept), "sequence_id", "offset")
