"""Evaluation of predictions.

Everything starts from one count per (truth, prediction) pair or per (subset,
bin); what follows works on a handful of rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import materialise, pinned


def ratio(a: Column, b: Column) -> Column:
    """Quotient, zero where the divisor is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def mistakes(df: DataFrame, correct: str = "correct") -> DataFrame:
    return df.filter(~F.col(correct))


def binary_metrics(df: DataFrame, truth: str, pred: str, positive: str) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1 of the positive class."""
    t, p = F.col(truth) == positive, F.col(pred) == positive
    counts = df.agg(
        F.count("*").alias("n"),
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(F.col(truth) == F.col(pred)).alias("hits"),
    )
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "n",
        "tp",
        "fp",
        "fn",
        F.round(ratio(F.col("hits"), F.col("n")), 6).alias("accuracy"),
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(f_score(precision, recall), 6).alias("f1"),
    )


def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.lit(0).alias("tp")),
        F.struct(
            F.col("pred").alias("label"),
            F.lit(0).alias("support"),
            F.col("n").alias("predicted"),
            F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
        ),
    )
    per_class = (
        pair_counts(df, truth, pred)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
        .withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", f_score(F.col("precision"), F.col("recall")))
    )

    def row(label, precision, recall, f1, support) -> Column:
        none = F.lit(None).cast("double")
        rounded = [none if c is None else F.round(c, 6) for c in (precision, recall, f1)]
        return F.struct(
            label.alias("label"),
            rounded[0].alias("precision"),
            rounded[1].alias("recall"),
            rounded[2].alias("f1"),
            support.cast("long").alias("support"),
        )

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    n = F.sum("support")
    summary = per_class.agg(
        # one element per class
        F.collect_list(row(F.col("label"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"))).alias("classes"),
        row(F.lit("accuracy"), None, None, ratio(F.sum("tp"), n), n).alias("accuracy"),
        row(F.lit("macro avg"), F.avg("precision"), F.avg("recall"), F.avg("f1"), n).alias("macro"),
        row(F.lit("weighted avg"), weighted("precision"), weighted("recall"), weighted("f1"), n).alias("weighted"),
    )
    return summary.select(F.inline(F.concat("classes", F.array("accuracy", "macro", "weighted"))))


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: list[str]) -> DataFrame:
    """One row per true label and one column per predicted label, in the given order; empty cells are zero."""
    counts = [F.count_if(F.col(pred) == label).alias(label) for label in labels]
    seen = df.filter(F.col(truth).isin(labels)).groupBy(F.col(truth).alias("truth")).agg(*counts)
    order = F.posexplode(F.lit(labels)).alias("place", "truth")
    every = df.sparkSession.range(1).select(order)
    filled = [F.coalesce(F.col(label), F.lit(0)).alias(label) for label in labels]
    return every.join(seen, "truth", "left").orderBy("place").select("truth", *filled)


def score_histogram(df: DataFrame, score: str, correct: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins over each subset's own range; the last bin is closed.

    A subset with a single value spreads half a unit to each side.  Empty bins
    are listed with zero.  ``df`` is evaluated once: its counts per subset and
    score are written here, and ranges and bins are found from them.
    """
    scores = materialise(df.groupBy(correct, score).agg(F.count("*").alias("n")), "scores")
    ranges = scores.groupBy(correct).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    same = F.col("hi") == F.col("lo")
    ranges = ranges.select(
        correct,
        F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    place = F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    ranges = pinned(ranges)  # one row per subset
    counts = scores.join(ranges, correct).groupBy(correct, place.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    grid = ranges.select(correct, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, [correct, "bin"], "left").select(
        correct,
        "bin",
        F.round(F.col("lo") + width * F.col("bin"), 6).alias("bin_from"),
        F.round(F.col("lo") + width * (F.col("bin") + 1), 6).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def moderation_stats(df: DataFrame, by: list[str] = []) -> DataFrame:
    """Dashboard counters; a missing flag counts as false."""
    def yes(c: Column) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False)))

    offensive = yes(F.col("is_offensive"))
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        offensive.alias("offensive"),
        (F.count("*") - offensive).alias("safe"),
        yes(F.col("reported")).alias("reported"),
        yes(F.col("user_classification") == "hate_speech").alias("classified_hate"),
        yes(F.col("user_classification") == "not_hate_speech").alias("classified_not_hate"),
    )
