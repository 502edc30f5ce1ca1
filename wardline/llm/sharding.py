"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash.  A bucket that exceeds
the byte limit is split on its next bit, and only such buckets, until each
holds at most the limit.  Sizes of all buckets come from one aggregation by a
prefix long enough for most splits; buckets that are too large even then are
aggregated again by more bits.  Nothing that grows with the rows is sent to the
driver: a table is broadcast only after counting that it is small.

The hash is the first 60 bits of the MD5 of the key.  Rows that agree in all of
them cannot be told apart by bits; their bucket continues in overflow pages, which
are filled in the order of the rows' digests.  A single row above the limit has
a page, or a shard, to itself.

Nulls and edge cases: a null key is hashed like the text ``null``; a null text
counts no bytes.  Repeated rows share a bucket, and pages if need be.  An empty
table gives an empty directory.  Columns of the input pass through ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialise

BITS = 60
# A table of at most so many rows is sent to the tasks.
FEW = 10_000


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("hash", BITS - bits)


def _counted(table: DataFrame) -> DataFrame:
    """``table`` for a join: sent whole to the tasks if it has few rows, else shuffled.

    Spark's own guess goes by the size of compressed files, and knows neither how rows unpack nor that ``explode``
    multiplies them.
    """
    return table.hint("broadcast" if table.count() <= FEW else "merge")


def directory(rows: DataFrame, limit: int) -> list[DataFrame]:
    """For each aggregation, (prefix, bits, depth, shard): the bucket of every prefix of ``bits`` bits that occurs.

    ``rows`` is (hash, bytes).  ``shard`` numbers a bucket by its bits after a leading 1.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits, found, left, above = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + 6), [], rows, 0
    while True:
        cells = materialise(left.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("bytes").alias("bytes")), "cells")
        at = F.call_function("shiftright", F.col("prefix"), (F.lit(bits) - F.col("depth")).cast("int"))
        depths = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        nodes = cells.select("prefix", "bytes", depths(above, bits)).withColumn("node", at)
        sizes = nodes.groupBy("depth", "node").agg(F.sum("bytes").alias("held"))
        # A bucket is a node that fits, or cannot be split here, while the node above does not fit: its two halves meet there.
        halves = sizes.groupBy((F.col("depth") - 1).alias("over"), F.shiftright("node", 1).alias("parent"))
        halves = halves.agg(F.sum("held").alias("whole"), F.collect_list(F.struct("depth", "node", "held")).alias("half"))
        ends = halves.select("whole", F.inline("half")).filter((F.col("whole") > limit) | (F.col("depth") == above))
        ends = materialise(ends.filter((F.col("held") <= limit) | (F.col("depth") == bits)).drop("whole"), "nodes")
        low, high = ends.agg(F.min("depth"), F.max("depth")).first()
        if low is None:
            return found
        # Only at depths that have buckets, so that no node near the root gathers all cells.
        lowest = cells.select("prefix", depths(low, high)).withColumn("node", at).join(_counted(ends), ["depth", "node"])
        lowest = materialise(lowest.select("prefix", "depth", "node", "held"), "buckets")
        split = lowest.filter(F.col("held") > limit).select("prefix")
        done = lowest.filter(F.col("held") <= limit) if bits < BITS else lowest
        shard = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth").cast("int")) + F.col("node")
        found.append(done.select("prefix", F.lit(bits).alias("bits"), "depth", shard.alias("shard"), (F.col("held") > limit).alias("paged")))
        if bits == BITS or split.isEmpty():
            return found
        left = left.withColumn("prefix", _prefix(bits)).join(_counted(split), "prefix", "left_semi").drop("prefix")
        above, bits = bits, min(BITS, bits + 8)


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, bytes, digest, depth, shard, page) of every row; a bucket has pages only if its rows share one hash."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("key"), key_hash(F.col(key)).alias("hash"), size.alias("bytes"), F.xxhash64(text).alias("digest"))
    rows = materialise(rows, "hashed")
    out = None
    for buckets in directory(rows.select("hash", "bytes"), limit):
        bits = buckets.select("bits").first()
        if bits is None:
            continue
        own = rows.withColumn("prefix", _prefix(bits[0])).join(_counted(buckets.drop("bits")), "prefix").drop("prefix")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return rows.withColumns({"depth": F.lit(0), "shard": F.lit(1).cast("long"), "page": F.lit(0).cast("long")})
    before = Window.partitionBy("hash").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    paged = out.filter("paged").withColumn("page", F.ceil(F.sum("bytes").over(before) / limit).cast("long"))
    return out.filter("NOT paged").withColumn("page", F.lit(0).cast("long")).unionByName(paged).drop("paged")


def _free(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as one Parquet folder per shard and page.

    The folders are called ``shard=`` and ``page=``, or ``shard_=`` and so on if ``docs`` has a column of that name.
    """
    places = assign(docs, limit, key, text).select("key", "digest", F.struct("shard", "page").alias("spot"))
    places = materialise(places, "places")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("digest"))
    spots = places.groupBy("key", "digest").agg(F.min("spot").alias("spot"), (F.min("spot") != F.max("spot")).alias("several"))
    renamed = lambda df, *more: df.select(F.col("key").alias("key of place"), F.col("digest").alias("digest of place"), *more)
    match = F.col("key").eqNullSafe(F.col("key of place")) & (F.col("digest") == F.col("digest of place"))
    found = whole.join(renamed(spots, "spot", "several"), match).drop("key of place", "digest of place")
    one = found.filter("NOT several").select("row", "spot")
    # Rows with one key and text on several pages: the n-th of them goes where the n-th place is.
    each = Window.partitionBy("key", "digest")
    rows = found.filter("several").drop("spot").withColumn("n of row", F.row_number().over(each.orderBy(F.xxhash64("row"))))
    theirs = renamed(places.withColumn("n", F.row_number().over(each.orderBy("spot"))), F.col("n").alias("n of place"), "spot")
    paged = rows.join(theirs, match & (F.col("n of row") == F.col("n of place"))).select("row", "spot")
    placed = one.unionByName(paged)
    shard, page = _free("shard", docs.columns), _free("page", docs.columns)
    placed = placed.select("row.*", F.col("spot.shard").alias(shard), F.col("spot.page").alias(page))
    placed.repartition(shard, page).write.partitionBy(shard, page).parquet(path)
