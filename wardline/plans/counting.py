"""A classifier whose training can go on from what was saved.

What it knows is a table of sums: per class and hash bucket, in how many texts
the bucket's terms stand and how often; per class, how many texts and terms
there are.  Sums of two sets of rows add up to the sums of both, so training on
A and then on B gives the very numbers of training on A and B, in any order and
on any number of partitions.  Document frequencies, IDF weights and the model
follow from the sums when they are needed.

The model is naive Bayes on which terms a text has, class against rest: a bucket
weighs the log ratio of its shares of texts in either, if that is ``SURE`` standard
errors from zero.  Long texts hold many terms, and without that bound the noise
of thousands of weights decides.  The model has at most one row for each of a
fixed number of buckets, whatever it was trained on; only that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardline.plans import term_hashes as th
from wardline.session import materialise

BUCKETS = 1 << 18
# At 4.5, about two of as many buckets would pass by chance.
SURE = 4.5
# The row of a class as a whole.
WHOLE = -1
STATE = "label string, bucket int, docs long, terms long"
# Classes of which a task keeps sums, two numbers a bucket each, before it passes them on.
HELD = 16


def term_buckets(c: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of words and of pairs of neighbouring words, sorted, repeats kept; null for a null text."""

    def work(texts: pa.Array) -> pa.Array:
        sizes, found = [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
        for _, rows, owner, bucket in th.bucket_parts(texts, buckets):
            keys = np.sort(owner << 32 | bucket)
            sizes.append(np.bincount(owner, minlength=rows))
            found.append((keys & 0xFFFFFFFF).astype(np.int32))
        offsets = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))

    return F.arrow_udf(work, "array<int>")(th.spaced_words(c))


def hashed(df: DataFrame, col: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the sorted buckets of ``col`` in its place, written: what counts terms more than once hashes them once."""
    return materialise(df.withColumn(col, _sorted_buckets(df, col, buckets)), "hashed")


def _sorted_buckets(df: DataFrame, col: str, buckets: int) -> Column:
    """The buckets of a text in order; a column that is ``hashed`` is taken as it is."""
    return F.col(col) if _is_hashed(df, col) else term_buckets(F.col(col), buckets)


def _is_hashed(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.ArrayType)


def _given(df: DataFrame, col: str) -> Column:
    """The texts as ``bucket_parts`` reads them."""
    return (F.col(col) if _is_hashed(df, col) else th.spaced_words(F.col(col))).alias("_given")


def _with_runs(df: DataFrame) -> DataFrame:
    """``df`` with ``runs``, each distinct bucket of the sorted buckets ``b`` with its number ``n``.

    To be exploded behind ``_whole``: of ``runs`` alone Spark infers a filter that works ``lead`` out for each place.
    """
    # A bucket's number of places is the distance of its first place from the next bucket's.
    lead = F.filter(F.sequence(F.lit(1), F.size("b")), lambda i: (i == 1) | (F.get("b", i - 1) != F.get("b", i - 2)))
    lead = F.when(F.size("b") > 0, lead).otherwise(F.array().cast("array<int>"))
    runs = F.transform("lead", lambda at, k: F.struct(F.get("b", at - 1).alias("bucket"), (F.coalesce(F.get("lead", k + 1), F.size("b") + 1) - at).alias("n")))
    return df.withColumn("lead", lead).withColumn("runs", runs).drop("lead")


def _whole() -> Column:
    """The row of a text as a whole."""
    return F.array(F.struct(F.lit(WHOLE).alias("bucket"), F.size("b").alias("n")))


def term_counts(df: DataFrame, id_col: str, col: str, buckets: int = BUCKETS) -> DataFrame:
    """``(id, bucket, tf)``: how often each bucket's terms stand in a text, or in all texts of an id.

    A text is counted within its row.  Only the counts of rows whose id is not theirs alone are shuffled.
    """
    shared = df.groupBy(id_col).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(F.col(id_col).alias("_id"), F.lit(True).alias("_shared"))
    # Written, as its size decides how the texts meet it.
    shared = materialise(shared, "shared")
    texts = df.filter(F.col(col).isNotNull()).select(id_col, _sorted_buckets(df, col, buckets).alias("b"))
    each = _with_runs(texts.join(shared, F.col(id_col).eqNullSafe(F.col("_id")), "left"))
    each = each.select(id_col, "_shared", F.explode(F.concat(_whole(), "runs")).alias("r")).filter(F.col("r.bucket") != WHOLE)
    each = each.select(id_col, "_shared", "r.bucket", F.col("r.n").cast("long").alias("tf"))
    own = each.filter("_shared IS NULL").select(id_col, "bucket", "tf")
    return own.unionByName(each.filter("_shared").groupBy(id_col, "bucket").agg(F.sum("tf").alias("tf")))


def count_terms(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The sums ``(label, bucket, docs, terms)`` of labelled rows (text, label); rows without text or label count for nothing.

    A text is counted within its row, and a task sums per class and bucket, so only those sums are shuffled.
    """
    known = rows.filter("text IS NOT NULL AND label IS NOT NULL").select("label", _given(rows, "text"))
    fields = [T.StructField("label", rows.schema["label"].dataType), *T.StructType.fromDDL("bucket int, docs long, terms long")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            labels, given = batch.columns
            labels = labels.dictionary_encode()
            names, codes = labels.dictionary, labels.indices.to_numpy()
            for first, n, owner, bucket in th.bucket_parts(given, buckets):
                keys, times = _distinct(owner << 32 | bucket)
                label, own = codes[first : first + n], keys >> 32
                for code in np.unique(label).tolist():
                    if (name := names[code].as_py()) not in held:
                        if len(held) == HELD:
                            yield from _sums(held, buckets, names.type)
                            held.clear()
                        held[name] = np.zeros((2, buckets + 1), np.int64)
                    docs, terms = held[name]
                    mine = label[own] == code
                    at = keys[mine] & 0xFFFFFFFF
                    np.add.at(docs, at, 1)
                    np.add.at(terms, at, times[mine])
                    # The last place is that of the class as a whole.
                    docs[WHOLE] += np.count_nonzero(label == code)
                    terms[WHOLE] += times[mine].sum()
        if held:
            yield from _sums(held, buckets, names.type)

    return added(known.mapInArrow(summed, T.StructType(fields)))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


def _sums(held: dict, buckets: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of what a task has summed."""
    for name, (docs, terms) in held.items():
        at = np.flatnonzero(docs)
        bucket = np.where(at == buckets, WHOLE, at).astype(np.int32)
        columns = [pa.repeat(pa.scalar(name, kind), len(at)), *map(pa.array, (bucket, docs[at], terms[at]))]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "bucket", "docs", "terms"])


def added(*states: DataFrame) -> DataFrame:
    """The sums of several trainings as one."""
    together = states[0]
    for other in states[1:]:
        together = together.unionByName(other)
    return together.groupBy("label", "bucket").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))


def bucket_idf(state: DataFrame) -> DataFrame:
    """``(bucket, df, idf)`` with ``idf = ln((1 + texts) / (1 + df)) + 1``."""
    texts = state.filter(F.col("bucket") == WHOLE).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("texts"))
    df = state.filter(F.col("bucket") != WHOLE).groupBy("bucket").agg(F.sum("docs").alias("df"))
    # One row on the other side.
    return df.crossJoin(F.broadcast(texts)).select("bucket", "df", (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))


def class_weights(state: DataFrame, sure: float = SURE) -> tuple[list[str], list[float], DataFrame]:
    """Classes, their log shares, and ``(bucket, weights)``: what a term of the bucket adds to each class."""
    wholes = state.filter(F.col("bucket") == WHOLE).groupBy("label").agg(F.sum("docs").alias("docs")).orderBy("label").collect()  # a row a class
    labels, sizes = [r["label"] for r in wholes], [r["docs"] for r in wholes]
    texts = sum(sizes)
    own = lambda label: F.sum(F.when(F.col("label") == label, F.col("docs")).otherwise(0))
    cells = state.filter(F.col("bucket") != WHOLE).groupBy("bucket")
    cells = cells.agg(F.sum("docs").alias("df"), *(own(label).alias(f"d{i}") for i, label in enumerate(labels)))

    def weight(i: int) -> Column:
        inside, outside = F.col(f"d{i}") + 0.5, F.col("df") - F.col(f"d{i}") + 0.5
        odds = F.log(inside / (sizes[i] + 1)) - F.log(outside / (texts - sizes[i] + 1))
        return F.when(F.abs(odds) >= sure * F.sqrt(1 / inside + 1 / outside), odds / 2).otherwise(0.0)

    weights = cells.select("bucket", F.array(*(weight(i) for i in range(len(labels)))).alias("weights"))
    return labels, [math.log(n / texts) for n in sizes], weights.filter(F.exists("weights", lambda w: w != 0))


def count_scores(df: DataFrame, id_col: str, col: str, state: DataFrame, buckets: int = BUCKETS, sure: float = SURE) -> DataFrame:
    """``df`` with ``scores array<struct<label, score>>`` and ``log_odds``, one number per class.

    ``id_col`` must be unique.  A text of which no term counts, also a null one,
    gets the shares of the classes.
    """
    labels, shares, weights = class_weights(state, sure)
    if not labels:
        raise ValueError("nothing has been learned yet")
    sums = _text_weights(df.select(id_col, _given(df, col)), weights, len(labels), buckets)
    sums = sums.groupBy(id_col).agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(labels))))
    out = df.join(sums, id_col, "left").withColumn(
        "log_odds", F.array(*(F.coalesce(f"_s{i}", F.lit(0.0)) + F.lit(shares[i]) for i in range(len(labels))))
    )
    top = F.array_max("log_odds")
    total = F.aggregate("log_odds", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    scores = F.transform(F.lit(labels), lambda label, i: F.struct(label.alias("label"), (F.exp(F.get("log_odds", i) - top) / total).alias("score")))
    return out.withColumn("scores", scores).drop(*(f"_s{i}" for i in range(len(labels))))


def _text_weights(given: DataFrame, weights: DataFrame, classes: int, buckets: int) -> DataFrame:
    """Per row that has a term of the model its id and, in ``_s0`` and so on, what its distinct buckets add to each class."""
    # At most ``buckets`` rows of one number per class.
    table = weights.toArrow()
    rows = np.full(buckets, -1, np.int32)
    rows[table["bucket"].to_numpy()] = np.arange(len(table))
    numbers = table["weights"].combine_chunks().flatten().to_numpy().reshape(len(table), classes)
    shared = given.sparkSession.sparkContext.broadcast((rows, numbers))
    schema = T.StructType([given.schema[0], *(T.StructField(f"_s{i}", T.DoubleType()) for i in range(classes))])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, adds = shared.value
        for batch in batches:
            ids, texts = batch.columns
            for first, _, owner, bucket in th.bucket_parts(texts, buckets):
                row = row_of[bucket]
                keys, _ = _distinct((owner << 32 | row)[row >= 0])
                own, row = keys >> 32, keys & 0xFFFFFFFF
                start = np.flatnonzero(np.diff(own, prepend=-1))
                sums = [np.add.reduceat(adds[row, i], start) if len(start) else np.empty(0) for i in range(classes)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + own[start])), *map(pa.array, sums)], names=schema.names)

    return given.mapInArrow(weighed, schema)


# -- saved training ------------------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose sums are complete."""
    context = spark.sparkContext
    done = context._jvm.org.apache.hadoop.fs.Path(f"{path}/upto=*/_SUCCESS")
    found = done.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(done) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def load_sums(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The saved sums, or those saved before a batch; empty if there are none."""
    done = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(STATE).parquet(f"{path}/upto={done[-1]}") if done else spark.createDataFrame([], STATE)


def go_on_training(rows: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> DataFrame:
    """Add labelled rows (text, label) to the saved sums, as batch number ``batch``.

    Batch numbers ascend.  A batch that runs again starts from what was saved
    before it and replaces what it wrote.
    """
    spark = rows.sparkSession
    added(load_sums(spark, path, batch), count_terms(rows, buckets)).write.mode("overwrite").parquet(f"{path}/upto={batch}")
    return load_sums(spark, path)


def stream_training(stream: DataFrame, path: str, checkpoint: str | None = None, once: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Train on labelled rows as they arrive."""
    from wardline.streaming.streams import sink_messages

    return sink_messages(stream, lambda df, batch: go_on_training(df, path, batch, buckets) and None, checkpoint, once)
