"""Label dimension, human overrides and the joins on them.

No join here carries a broadcast hint: the label dimension is a literal table
whose size Spark knows, and overrides grow with the feedback, so Spark decides
by measured size and adaptive execution splits hot keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.session import small_table

# Raw label, canonical label, id, display, severity, safe.
LABELS = [
    ("Not_offensive", "Not_offensive", 0, "Safe", "safe", True),
    ("not-malayalam", "Not_in_intended_language", 1, "Not Malayalam", "safe", True),
    ("Not_in_intended_language", "Not_in_intended_language", 1, "Not Malayalam", "safe", True),
    ("Offensive_Targeted_Insult_Group", "Off_target_group", 2, "Group Hate Speech", "high", False),
    ("Off_target_group", "Off_target_group", 2, "Group Hate Speech", "high", False),
    ("Offensive_Untargetede", "Profanity", 3, "Profanity / Vulgarity", "high", False),
    ("Profanity", "Profanity", 3, "Profanity / Vulgarity", "high", False),
    ("Offensive_Targeted_Insult_Individual", "Off_target_ind", 4, "Personal Attack", "high", False),
    ("Off_target_ind", "Off_target_ind", 4, "Personal Attack", "high", False),
]
SAFE_LABEL = "Not_offensive"
DEFAULT_REPORT_LABEL = "Offensive_Untargetede"
SAFE_LABELS = ["Not_offensive", "Not_in_intended_language"]
HUMAN_SOURCES = ["user_classify", "feedback"]
CLASSES = ["Not_offensive", "Not_in_intended_language", "Off_target_group", "Profanity", "Off_target_ind"]

_SCHEMA = pa.schema(
    [
        ("raw", pa.string()),
        ("canonical", pa.string()),
        ("label_id", pa.int32()),
        ("display", pa.string()),
        ("severity", pa.string()),
        ("is_safe", pa.bool_()),
    ]
)


def label_dim(spark: SparkSession) -> DataFrame:
    names = _SCHEMA.names
    return small_table(spark, [dict(zip(names, row)) for row in LABELS], _SCHEMA)


def canonical_dim(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("raw") == F.col("canonical"))


def map_labels(df: DataFrame, dim: DataFrame, col: str = "label", out: str = "mapped_label") -> DataFrame:
    """Raw to canonical label; rows with an unknown label are dropped."""
    return df.join(dim.select(F.col("raw").alias(col), F.col("canonical").alias(out)), col)


def label_ids(df: DataFrame, dim: DataFrame, col: str = "mapped_label") -> DataFrame:
    ids = canonical_dim(dim).select(F.col("canonical").alias(col), "label_id")
    return df.join(ids, col)


def label_meta(df: DataFrame, dim: DataFrame, path: str = "model", col: str = "label") -> DataFrame:
    """Add display and severity.  Unknown labels show as themselves; their severity depends on the path."""
    meta = canonical_dim(dim).select(
        F.col("canonical").alias(col), F.col("display").alias("_display"), F.col("severity").alias("_severity")
    )
    if path == "model":
        unknown = F.lit("unknown")
    else:
        unknown = F.when(F.col(col) != SAFE_LABEL, "high").otherwise("safe")
    return (
        df.join(meta, col, "left")
        .withColumn("label_display", F.coalesce("_display", F.col(col)))
        .withColumn("severity", F.coalesce("_severity", unknown))
        .drop("_display", "_severity")
    )


def label_is_safe(c: Column) -> Column:
    return c.isin(SAFE_LABELS)


def build_overrides(corpus: DataFrame) -> DataFrame:
    """``(key, label, seq)``: the last human label per normalised text.

    A maximum per key combines on the map side, so a text labelled a billion
    times is no hot spot.
    """
    return (
        corpus.filter(F.col("extra").isin(HUMAN_SOURCES) & F.col("text").isNotNull())
        .groupBy(tx.norm_key(F.col("text")).alias("key"))
        .agg(F.max_by("label", "seq").alias("label"), F.max("seq").alias("seq"))
    )


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """Add ``forced_label`` (null where no human has decided)."""
    forced = overrides.select(F.col("key").alias(key), F.col("label").alias("forced_label"))
    return df.join(forced, key, "left")
