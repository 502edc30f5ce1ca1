"""Column functions on model scores: ``array<struct<label: string, score: double>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decision threshold, severity cuts, gate scores.
THRESHOLD = 0.8
MILD_BELOW = 0.80
HIGH_BELOW = 0.95
GATE_SCORE = 0.99
GATE_REST = 0.01

SCORES_TYPE = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
)


def score_list(**scores: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("label"), v.cast("double").alias("score")) for k, v in scores.items()])


def safe_score(scores: Column, safe_labels: list[str]) -> Column:
    """Sum of the scores of the safe labels."""
    safe = F.filter(scores, lambda s: s["label"].isin(safe_labels))
    return F.aggregate(safe, F.lit(0.0), lambda acc, s: acc + s["score"])


def fold_scores(scores: Column, safe_labels: list[str]) -> Column:
    """Offensive score: what the safe labels leave of one."""
    return F.lit(1.0) - safe_score(scores, safe_labels)


def is_offensive(score: Column, threshold: float = THRESHOLD) -> Column:
    return score > threshold


def top_label(scores: Column) -> Column:
    """Label with the highest score; the earliest one on a tie."""
    ranked = F.transform(
        scores, lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("rank"), s["label"].alias("label"))
    )
    return F.array_max(ranked)["label"]


def bucket(score: Column, threshold: float = THRESHOLD) -> Column:
    return (
        F.when(~is_offensive(score, threshold), "safe")
        .when(score < MILD_BELOW, "mild")
        .when(score < HIGH_BELOW, "high")
        .otherwise("extreme")
    )


def rounded(c: Column, places: int = 4) -> Column:
    """Half-even rounding."""
    return F.bround(c, places)


def scores_map(scores: Column) -> Column:
    return F.map_from_entries(
        F.transform(scores, lambda s: F.struct(s["label"].alias("key"), rounded(s["score"]).alias("value")))
    )
