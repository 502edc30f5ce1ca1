"""Human review: queue, progress and agreement with the model.

Items are ``(seq, text, ai_label)``, verified labels ``(text, label)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import evaluation
from wardline.operators.curation import by_digest
from wardline.operators.labels import label_is_safe


def pending_review(items: DataFrame, verified: DataFrame, col: str = "text") -> DataFrame:
    return by_digest(items, verified, col, "left_anti")


def next_item(
    items: DataFrame, verified: DataFrame, skipped: DataFrame | None = None, n: int = 1, order: str = "seq"
) -> DataFrame:
    """The next ``n`` items in order that are neither verified nor skipped."""
    left = pending_review(items, verified)
    if skipped is not None:
        left = left.join(skipped.select(order).distinct(), order, "left_anti")
    return left.orderBy(order).limit(n).withColumn("looks_safe", label_is_safe(F.col("ai_label")))


def review_progress(items: DataFrame, verified: DataFrame) -> DataFrame:
    """``(total, done, left, pct)``: done counts all verified texts, left only listed items."""
    key = tx.digest(F.col("text")).alias("_key")
    keys = verified.select(key).distinct()
    done = keys.agg(F.count("*").alias("done")).scalar()
    counts = items.select(key).join(keys.withColumn("_known", F.lit(True)), "_key", "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("_known").isNull()).alias("left")
    )
    counts = counts.withColumn("done", done)
    pct = F.floor(F.try_divide(F.col("done").cast("double"), F.col("total").cast("double")) * 100 + 0.5)
    return counts.select("total", "done", "left", pct.cast("long").alias("pct"))


def human_vs_model(items: DataFrame, verified: DataFrame, col: str = "text") -> DataFrame:
    """Items with a verified label: both labels and both safe/offensive verdicts."""
    key = tx.digest(F.col(col))
    human = verified.select(key.alias("_key"), F.col("label").alias("human_label"))
    verdict = lambda c: F.when(label_is_safe(F.col(c)), "Not_offensive").otherwise("Offensive")
    paired = items.withColumn("_key", key).join(human, "_key").drop("_key")
    return paired.withColumns({"human": verdict("human_label"), "model": verdict("ai_label")})


def review_metrics(items: DataFrame, verified: DataFrame) -> DataFrame:
    """Agreement of the model with the human labels, in percent, and how many there are."""
    scored = evaluation.binary_metrics(human_vs_model(items, verified), "human", "model", "Offensive")
    names = ["accuracy", "precision", "recall", "f1"]
    return scored.select(F.col("n").alias("verified_count"), *[F.round(F.col(c) * 100, 2).alias(c) for c in names])


def review_report(items: DataFrame, verified: DataFrame) -> DataFrame:
    return evaluation.class_report(human_vs_model(items, verified), "human", "model")
