"""Exact, reproducible splits that do not sort a class in one task.

Rows are ranked by ``md5(seed:key)``.  Exactly the first k of a class go to the
holdout, but only one narrow slice of the hash range is ever ranked: counts per
(class, hash prefix) show in which slice the cut falls, ranking that slice gives
the last row held out, and every row is then compared with it in a narrow pass.
``key`` must be unique, so a slice of a 16-bit prefix holds about 1/65536 of a
class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.curation import shuffle_key
from wardline.session import pinned

PREFIX_DIGITS = 4


def holdout_sizes(counts: DataFrame, label: str, frac: float) -> DataFrame:
    """``(label, k)`` from ``(label, n)``: how many rows of each class to hold out.

    In total ``ceil(frac * N)`` rows; training shares are proportional, rounded
    down, and what is missing goes to the largest remainders.  One row per
    class, so the windows below are as small as the label set.
    """
    whole = W.partitionBy()
    total = F.sum("n").over(whole)
    train_total = total - F.ceil(total * F.lit(frac))
    # integer arithmetic: n * train_total / total as quotient and remainder
    scaled = counts.withColumn("_train", train_total).withColumn("_total", total)
    parts = scaled.withColumn("_floor", F.expr("(n * _train) div _total")).withColumn(
        "_rest", F.expr("(n * _train) % _total")
    )
    missing = F.col("_train") - F.sum("_floor").over(whole)
    place = F.row_number().over(W.orderBy(F.desc("_rest"), label))
    return (
        parts.withColumn("_missing", missing)
        .withColumn("_place", place)
        .select(label, (F.col("n") - F.col("_floor") - (F.col("_place") <= F.col("_missing")).cast("int")).alias("k"))
    )


def assign_split(df: DataFrame, key: str, label: str, frac: float, seed: int) -> DataFrame:
    """Add ``is_holdout``: exact, stratified, the same on any partitioning."""
    # one row per class each: the size of the label set is counted before it is relied upon
    hashed = df.withColumn("_h", shuffle_key(F.col(key), seed)).withColumn("_slice", F.substring("_h", 1, PREFIX_DIGITS))
    slices = hashed.groupBy(label, "_slice").agg(F.count("*").alias("_m"))
    sizes = holdout_sizes(slices.groupBy(label).agg(F.sum("_m").alias("n")), label, frac)
    running = W.partitionBy(label).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # Per class: the slice in which the k-th row falls, and how many of its rows to take.
    cut = pinned(
        slices.withColumn("_before", F.coalesce(F.sum("_m").over(running), F.lit(0)))
        .join(sizes, label)
        .filter((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_m")))
        .select(label, F.col("_slice").alias("_cut"), (F.col("k") - F.col("_before")).alias("_take"))
    )
    # Rank that slice only, to find the last row held out; then compare every row with it.
    rank = F.row_number().over(W.partitionBy(label).orderBy("_h", key))
    last = pinned(
        hashed.select(label, key, "_h", "_slice")
        .join(cut, label)
        .filter(F.col("_slice") == F.col("_cut"))
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_take"))
        .select(label, F.col("_h").alias("_last_h"), F.col(key).alias("_last_key"))
    )
    held = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col(key) <= F.col("_last_key")))
    return (
        hashed.join(last, label, "left")
        .withColumn("is_holdout", F.coalesce(held, F.lit(False)))
        .drop("_h", "_slice", "_last_h", "_last_key")
    )


def stratified_split(
    df: DataFrame, key: str, label: str, frac: float = 0.2, seed: int = 99
) -> tuple[DataFrame, DataFrame]:
    """``(train, holdout)``, disjoint and exhaustive."""
    assigned = assign_split(df, key, label, frac, seed)
    return (
        assigned.filter(~F.col("is_holdout")).drop("is_holdout"),
        assigned.filter("is_holdout").drop("is_holdout"),
    )


def split(df: DataFrame, key: str, frac: float = 0.05, seed: int = 99) -> tuple[DataFrame, DataFrame]:
    """The same without strata."""
    one = df.withColumn("_all", F.lit(0))
    train, held = stratified_split(one, key, "_all", frac, seed)
    return train.drop("_all"), held.drop("_all")
