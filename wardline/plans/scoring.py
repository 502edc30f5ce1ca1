"""Scorers: each adds ``scores array<struct<label, score>>`` and keeps every other column.

No join aligns predictions with rows; a score is written next to its row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from wardline.functions import scores as sc
from wardline.operators import lexicon as lx
from wardline.operators.labels import CLASSES


class Scorer(Protocol):
    def __call__(self, df: DataFrame, col: str) -> DataFrame: ...


def lexicon_scorer(terms: list[str]) -> Scorer:
    """h gate hits give Profanity h/(h+1) and Not_offensive 1/(h+1)."""
    def score(df: DataFrame, col: str) -> DataFrame:
        hits = lx.gate_count(F.col(col), terms)
        parts = sc.score_list(Not_offensive=1 / (F.col("_h") + 1), Profanity=F.col("_h") / (F.col("_h") + 1))
        return df.withColumn("_h", hits).withColumn("scores", parts).drop("_h")

    return score


def pipeline_scorer(model: PipelineModel, labels: list[str] = CLASSES) -> Scorer:
    """A fitted Spark ML pipeline that reads ``text`` and writes ``probability``.

    A model trained without the last classes has a shorter probability vector;
    the missing ones score zero.
    """
    def score(df: DataFrame, col: str) -> DataFrame:
        own = df.withColumnRenamed("text", "_own_text") if col != "text" and "text" in df.columns else df
        scored = model.transform(own.withColumn("text", F.col(col)))
        # Outside the function, which Spark would have predict again for each label.
        probability = F.slice(vector_to_array("probability"), 1, len(labels))
        parts = F.zip_with(F.lit(labels), probability, lambda label, p: F.struct(label.alias("label"), F.coalesce(p, F.lit(0.0)).alias("score")))
        kept = [F.col("_own_text").alias(c) if c == "text" and own is not df else F.col(c) for c in df.columns]
        return scored.select(*kept, parts.alias("scores"))

    return score


def batch_scorer(load: Callable[[], Callable[[list[str]], list[dict[str, float]]]], needed: str | None = None) -> Scorer:
    """A Python model: ``load()`` runs once per task and returns a function on a list of texts.

    Only the text travels, in Arrow batches; the other columns stay in the JVM.
    Rows whose ``needed`` column is false pass through without being scored.
    """
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for text, wanted in parts:
            todo = wanted.fillna(False).astype(bool)
            out = pd.Series([None] * len(text), index=text.index, dtype=object)
            texts = text[todo].tolist()
            for place, found in zip(text.index[todo], predict(texts) if texts else []):
                out.at[place] = [{"label": k, "score": float(v)} for k, v in found.items()]
            yield out

    # A row is scored once, wherever its scores are read.
    scores = F.pandas_udf(run, sc.SCORES_TYPE, functionType=PandasUDFType.SCALAR_ITER).asNondeterministic()

    def score(df: DataFrame, col: str) -> DataFrame:
        wanted = F.coalesce(F.col(needed), F.lit(False)) if needed else F.lit(True)
        return df.withColumn("scores", scores(F.when(wanted, F.col(col)), wanted))

    return score
