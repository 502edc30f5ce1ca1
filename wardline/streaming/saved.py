"""Which texts a stream has saved, without reading them again.

Each micro-batch saves its new texts in a folder of its own, ``batch=N``, which
stays.  Of every ``FAN`` folders only the digests are merged into a table
partitioned by the first byte of the digest, of every ``FAN`` such tables into
a larger one, and so on: a digest is rewritten once for each level, and a batch
reads at most ``FAN - 1`` tables a level, of which it opens the partitions that
its own digests fall into, and the last ``FAN - 1`` folders at most.

A batch that runs again finds only earlier batches, and overwrites what it
wrote.  Merged tables are written before those they replace are deleted; only a
batch that is complete is merged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as tx

FAN = 10
PREFIXES = 256
_DIGESTS = "digest binary, prefix int"


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, 2), 16, 10).cast("int")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> bool:
    done, system = _folder(spark, f"{path}/_SUCCESS")
    return system.exists(done)


def _merged(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First and last batch of every merged table; a wider one before those within it."""
    pattern, system = _folder(spark, f"{path}/_digests/*/_SUCCESS")
    found = (re.fullmatch(r"(\d+)-(\d+)", x.getPath().getParent().getName()) for x in system.globStatus(pattern) or [])
    return sorted(((int(m[1]), int(m[2])) for m in found if m), key=lambda r: (r[0], -r[1]))


def _cover(spark: SparkSession, path: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The widest merged tables within batches low to high - 1, and the batches that are in none of them."""
    tables, rest, at = [], [], low
    for first, last in _merged(spark, path):
        if first >= at and last < high:
            tables.append((first, last))
            rest += range(at, first)
            at = last + 1
    rest += range(at, high)
    return tables, [b for b in rest if _complete(spark, f"{path}/batch={b}")]


def _digests(spark: SparkSession, path: str, low: int, high: int, prefixes: list[int] | None = None) -> DataFrame:
    """``(digest, prefix)`` of the texts of batches low to high - 1, of the given prefixes only."""
    tables, batches = _cover(spark, path, low, high)
    out = spark.createDataFrame([], _DIGESTS)
    for first, last in tables:
        out = out.unionByName(spark.read.schema(_DIGESTS).parquet(f"{path}/_digests/{first}-{last}"))
    if batches:
        texts = spark.read.schema("text string").parquet(*(f"{path}/batch={b}" for b in batches))
        digest = texts.filter("text IS NOT NULL").select(tx.digest(F.col("text")).alias("digest"))
        out = out.unionByName(digest.withColumn("prefix", _prefix(F.col("digest"))))
    return out if prefixes is None else out.filter(F.col("prefix").isin(prefixes))


def merge(spark: SparkSession, path: str, batch: int, fan: int = FAN) -> None:
    """Merge what lies before ``batch``, if it is the first one of a level."""
    width = fan
    while batch and batch % width == 0:
        low, name = batch - width, f"{path}/_digests/{batch - width}-{batch - 1}"
        if not _complete(spark, name):
            rows = _digests(spark, path, low, batch).repartitionByRange("prefix", "digest")
            rows.sortWithinPartitions("prefix", "digest").write.mode("overwrite").partitionBy("prefix").parquet(name)
        for first, last in _merged(spark, path):
            if low <= first and last < batch and (first, last) != (low, batch - 1):
                folder, system = _folder(spark, f"{path}/_digests/{first}-{last}")
                system.delete(folder, True)
        width *= fan


def known(rows: DataFrame, path: str, batch: int) -> DataFrame:
    """Digests saved before ``batch`` that share a prefix with those of ``rows`` (digest)."""
    found = rows.select(_prefix(F.col("digest")).alias("prefix")).distinct().collect()  # at most ``PREFIXES``
    prefixes = [r["prefix"] for r in found]
    return _digests(rows.sparkSession, path, 0, batch, prefixes if len(prefixes) < PREFIXES else None).select("digest")


def subtract_saved(rows: DataFrame, path: str, batch: int, fan: int = FAN) -> DataFrame:
    """The rows whose text no batch before this one has saved."""
    merge(rows.sparkSession, path, batch, fan)
    keyed = rows.withColumn("_digest", tx.digest(F.col("text")))
    seen = known(keyed.select(F.col("_digest").alias("digest")), path, batch).withColumnRenamed("digest", "_digest")
    return keyed.join(seen, "_digest", "left_anti").drop("_digest")
