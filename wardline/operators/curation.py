"""Curation of labelled rows: union, dedupe, filters, ordering.

First and last always mean an explicit order; Spark rows have none.  Picks per
key are aggregates (``max_by``/``min_by``), which combine on the map side,
rather than row numbers, which would sort a hot key in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators.labels import HUMAN_SOURCES
from wardline.session import pinned

# Later sources win: seed corpus, then model-labelled chat, then human feedback.
SOURCE_RANK = {"corpus": 0, "user_chat": 1, "feedback": 2}


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["text", "label"])


def union_sources(sources: dict[str, DataFrame | None], rank: dict[str, int] = SOURCE_RANK) -> DataFrame:
    """Union of ``(text, label, extra, seq)`` sources with a rank; missing sources are skipped.

    Human rows inside the corpus rank with the feedback, so that a model's own
    label never replaces a human one.
    """
    parts = []
    for name, df in sources.items():
        if df is None:
            continue
        human = F.col("extra").isin(HUMAN_SOURCES)
        parts.append(
            df.select("text", "label", "extra", "seq")
            .withColumn("source", F.lit(name))
            .withColumn(
                "source_rank", F.when(F.coalesce(human, F.lit(False)), max(rank.values())).otherwise(rank[name])
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _keep(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def top1(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """The row with the highest ``by`` per group."""
    return _keep(df, group, by, F.max_by)


def first_match(candidates: DataFrame, group: list[str], pos: str) -> DataFrame:
    """The candidate with the lowest position per group."""
    return _keep(candidates, group, [pos], F.min_by)


def label_distribution(df: DataFrame, col: str = "mapped_label") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def drop_rare(df: DataFrame, col: str = "mapped_label", min_n: int = 2) -> DataFrame:
    """Rows of classes with at least ``min_n`` rows: counted by an aggregate, kept by a semi join."""
    frequent = df.groupBy(col).agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)
    return df.join(pinned(frequent.select(col)), col, "left_semi")


def chronological(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*order)


def shuffle_key(c: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A pseudo-random order that depends on the seed and the key only (``key`` unique)."""
    return df.orderBy(shuffle_key(F.col(key), seed), key)


def split_sizes(named: dict[str, DataFrame]) -> DataFrame:
    """Row count per named frame."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("split"), "n") for name, df in named.items()]
    return reduce(DataFrame.unionByName, counts)


def overlap(test: DataFrame, train: DataFrame, col: str = "text") -> DataFrame:
    """Test rows whose text, case and outer space aside, stands in the training data."""
    return by_digest(test, train, col, "left_semi", tx.norm_key)


def remove_overlap(test: DataFrame, train: DataFrame, col: str = "text") -> DataFrame:
    return by_digest(test, train, col, "left_anti", tx.norm_key)


def by_digest(a: DataFrame, b: DataFrame, col: str, how: str, key: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Semi or anti join on a text column: one copy of the texts of ``a`` is shuffled, and digests of those of ``b``."""
    keys = b.filter(F.col(col).isNotNull()).select(tx.digest(key(F.col(col))).alias("_key")).distinct()
    return a.withColumn("_key", tx.digest(key(F.col(col)))).join(keys, "_key", how).select(*a.columns)


def intersect_texts(a: DataFrame, b: DataFrame, col: str = "text") -> DataFrame:
    """Distinct normalised texts present in both frames."""
    key = tx.norm_key(F.col(col)).alias(col)
    return a.filter(F.col(col).isNotNull()).select(key).intersect(b.filter(F.col(col).isNotNull()).select(key))


def subtract_texts(a: DataFrame, b: DataFrame, col: str = "text") -> DataFrame:
    """Rows of ``a`` whose exact text is not in ``b``; duplicates in ``a`` stay."""
    return by_digest(a, b, col, "left_anti")


def union_generated(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)
