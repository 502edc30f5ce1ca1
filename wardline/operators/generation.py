"""Template-generated test rows with known truth.

Each row picks its template and slot values by a hash of (seed, slot, id), so
any number of rows is generated in parallel and again the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import curation


def render(id_col: Column, templates: list[str], slots: dict[str, list[str]], seed: int) -> Column:
    """Fill a template; ``{name}`` stands for a value of slot ``name``."""
    def choose(options: list[str], name: str) -> Column:
        return tx.pick(options, F.concat(F.lit(f"{seed}:{name}:"), id_col.cast("string")))

    text = choose(templates, "template")
    for name, options in slots.items():
        text = F.replace(text, F.lit("{%s}" % name), choose(options, name))
    return tx.strip(text)


def generate_from(
    ids: DataFrame, id_col: str, templates: list[str], slots: dict[str, list[str]], label: str, seed: int
) -> DataFrame:
    """``(id, text, true_label)``: one row per id."""
    return ids.select(
        F.col(id_col).alias("id"), render(F.col(id_col), templates, slots, seed).alias("text"), F.lit(label).alias("true_label")
    )


def generate(
    spark: SparkSession, n: int, templates: list[str], slots: dict[str, list[str]], label: str, seed: int = 7
) -> DataFrame:
    return generate_from(spark.range(n), "id", templates, slots, label, seed)


def unseen(generated: DataFrame, train: DataFrame) -> DataFrame:
    """Generated rows whose text does not occur in the training data."""
    return curation.remove_overlap(generated, train)


def generate_unseen(
    spark: SparkSession,
    n: int,
    templates: list[str],
    slots: dict[str, list[str]],
    label: str,
    train: DataFrame,
    seed: int = 7,
) -> DataFrame:
    return unseen(generate(spark, n, templates, slots, label, seed), train)
