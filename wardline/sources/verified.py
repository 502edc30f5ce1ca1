"""Verified labels: JSON objects of texts and labels, of any size.

A file is cut at its quotation marks, so it is read in splits, and no row holds more than one string; a whole object
never meets in memory.  Whether a split begins within a string follows from the number of quotation marks in the splits
before it.  Outside of strings a comma ends a pair; pairs that lie in several splits are put together.  Each pair is
parsed by Spark, so escapes, numbers and nulls are read as ``from_json`` reads them, but a text may be longer than the
50,000 characters that it allows a key.

A file that is not one such object of strings, numbers, booleans and nulls (objects or arrays as values, single quotes,
a byte order mark, something after the object, or no valid JSON) is left to ``from_json``, which holds it whole; it has
no rows if it is not valid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.session import materialise, pinned

_SPACE = b" \t\r\n"
_FOREIGN = re.compile(rb"[{}\[\]'\\]")
# What a split gives: the end of a pair that began before it, the beginning of one that ends after it, a whole pair, or a
# sign that the file is none that is read in splits.
_END, _BEGIN, _PAIR, _OTHER = range(4)
_FOUND = "file string, start long, kind int, body binary"
# Pieces that are taken out of an Arrow batch at once.
_AT_ONCE = 256


class _Split:
    """The pairs of one split as ``text, label``: the colon between them becomes a comma."""

    def __init__(self, file: str, start: int, inside: bool, last: bool):
        self.key, self.inside, self.last = (file, start), inside, last
        self.first = self.open = start == 0  # open: the newest pair begins in this split
        self.many = start != 0 or not last  # the object has a comma, or may have one elsewhere
        self.body: list[bytes] = []
        self.held: bytes | None = None  # the newest piece may be the last of the file
        self.found: list[tuple[int, bytes]] = []
        self.other = False

    def add(self, piece: bytes) -> None:
        if self.held is not None:
            self._take(self.held, False)
        self.held = piece

    def end(self) -> None:
        self._take(self.held, self.last)
        if self.other:
            self.found = [(_OTHER, b"")]
        elif not self.last:
            self.found.append((_BEGIN if self.open else _END, b"".join(self.body)))
        elif self.many or b"".join(self.body).strip(_SPACE):  # else an empty object
            self._close()

    def _close(self) -> None:
        self.found.append((_PAIR if self.open else _END, b"".join(self.body)))
        self.body, self.open, self.many = [], True, True

    def _take(self, piece: bytes, final: bool) -> None:
        if self.other:
            return
        if self.inside:
            self.other = final
            self.body.append(piece)
        else:
            self._outside(piece, final)
        escaped = (len(piece) - len(piece.rstrip(b"\\"))) % 2
        self.inside ^= not escaped
        self.first = False
        if not final:
            self.body.append(b'"')

    def _outside(self, piece: bytes, final: bool) -> None:
        if self.first:
            piece = piece.lstrip(_SPACE)
            self.other |= not piece.startswith(b"{")
            piece = piece[1:]
        if final:
            piece = piece.rstrip(_SPACE)
            self.other |= not piece.endswith(b"}")
            piece = piece[:-1]
        self.other |= bool(_FOREIGN.search(piece))
        own, *more = piece.replace(b":", b"\0").split(b",")
        self.other |= b"\0" in piece
        self.body.append(own.replace(b"\0", b","))
        for part in more:
            self._close()
            self.body.append(part.replace(b"\0", b","))


def _given(split: _Split) -> Iterator[pa.RecordBatch]:
    """What the split has found so far."""
    if split.found:
        kinds, bodies = zip(*split.found, strict=True)
        file, start = split.key
        split.found = []
        columns = [pa.array([file] * len(kinds)), pa.array([start] * len(kinds)), pa.array(kinds, pa.int32()), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "body"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, inside, last, piece), split by split in the order of the file, as rows of ``_FOUND``."""
    split = None
    for batch in batches:
        for low in range(0, batch.num_rows, _AT_ONCE):
            for file, start, inside, last, piece in zip(*(c.to_pylist() for c in batch.slice(low, _AT_ONCE).columns), strict=True):
                if split is None or split.key != (file, start):
                    if split is not None:
                        split.end()
                        yield from _given(split)
                    split = _Split(file, start, inside, last)
                split.add(piece)
            yield from _given(split)
    if split is not None:
        split.end()
        yield from _given(split)


def _splits(pieces: DataFrame) -> DataFrame:
    """(file, start, inside, last, other): one row for each split that has pieces."""
    # A quotation mark after an odd number of backslashes is part of a string.
    slashes = F.when(F.col("piece").endswith("\\"), F.length(F.regexp_extract("piece", r"(?<!\\)(\\++)\z", 1))).otherwise(0)
    sums = pieces.groupBy("file", "start").agg(
        F.count_if(slashes % 2 == 0).alias("marks"), F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("size").alias("size")
    )
    file = Window.partitionBy("file")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "file", "start", (F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        F.lead("start").over(file.orderBy("start")).isNull().alias("last"),
        (F.sum("bytes").over(file) < F.col("size")).alias("other"),  # a mark at the beginning was left out
    )


def _joined(parts: DataFrame) -> DataFrame:
    """(file, body) of the pairs that lie in several splits, from their ends and beginnings."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    pairs = parts.withColumn("pair", F.sum("kind").over(order)).groupBy("file", "pair")
    pairs = pairs.agg(F.array_sort(F.collect_list(F.struct("start", "kind", "body"))).alias("parts"))
    return pairs.select("file", F.array_join(F.col("parts.body"), "").alias("body"))


def _parsed(pairs: DataFrame) -> DataFrame:
    """Add ``both``, an array of text and label, null if the body is no such pair."""
    both = F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<string>")
    named = F.col("body").rlike(r'\A[ \t\r\n]*"')
    return pairs.withColumn("both", both).withColumn("both", F.when(named & (F.size("both") == 2), F.col("both")))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of all objects under a path as ``(text, label)``; the call itself goes through the files, to see which are such objects."""
    meta = lambda name: F.col(f"_metadata.{name}")
    pieces = spark.read.text(path, lineSep='"').select(
        meta("file_path").alias("file"), meta("file_block_start").alias("start"), meta("file_size").alias("size"), F.col("value").alias("piece")
    )
    splits = pinned(_splits(pieces))
    # One row per split is sent to the tasks; pieces stay in their order, which a shuffle would lose.
    placed = pieces.join(F.broadcast(splits.drop("other")), ["file", "start"]).select("file", "start", "inside", "last", F.col("piece").cast("binary"))
    found = _parsed(placed.mapInArrow(_pairs, _FOUND).withColumn("body", F.col("body").cast("string")))
    # At most two parts a split, and what is no pair.
    rest = found.filter((F.col("kind") != _PAIR) | F.col("both").isNull())
    rest = materialise(rest.select("file", "start", "kind", F.when(F.col("kind") < _PAIR, F.col("body")).alias("body")), "parts")
    joined = _parsed(_joined(rest.filter(F.col("kind") < _PAIR)))
    others = rest.filter(F.col("kind") >= _PAIR).select("file").union(joined.filter(F.col("both").isNull()).select("file"))
    # The driver holds the list of files as it is.
    others = [row["file"] for row in others.union(splits.filter("other").select("file")).distinct().collect()]
    pairs = found.filter(F.col("kind") == _PAIR).select("file", "both").unionByName(joined.select("file", "both"))
    if others:
        pairs = pairs.filter(~F.col("file").isin(others))
    pairs = pairs.select(F.col("both")[0].alias("text"), F.col("both")[1].alias("label"))
    if not others:
        return pairs
    # Files are passed over by name, before they are read.
    whole = spark.read.text(path, wholetext=True).filter(meta("file_path").isin(others))
    return pairs.unionByName(whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("text", "label")))
