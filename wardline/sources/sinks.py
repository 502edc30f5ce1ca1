"""Writers.  Everything that grows is appended; nothing is rewritten as a whole."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import curation


def append_labels(df: DataFrame, path: str) -> None:
    """Labelled rows for the training corpus."""
    df.select("text", "label", "extra", "seq").write.mode("append").parquet(path)


def append_user_chat(df: DataFrame, path: str, order: str = "seq") -> None:
    """Model-labelled chat texts: the first message with a text, unless the text is there already."""
    rows = curation.keep_first(df.select("text", "label", order), ["text"], [order])
    rows = rows.select("text", "label", F.lit("user_chat").alias("extra"), F.col(order).alias("seq"))
    try:
        saved = df.sparkSession.read.schema(rows.schema).parquet(path)
        rows = curation.subtract_texts(rows, saved)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit rows, one folder per day."""
    rows = df.select(*schemas.FEEDBACK.names).withColumn("day", F.to_date("ts"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def write_messages(df: DataFrame, path: str) -> None:
    """Classified messages; their current state comes from the action log, not from rewriting them."""
    df.write.mode("append").parquet(path)


def write_splits(train: DataFrame, holdout: DataFrame, path: str) -> None:
    """Training rows with raw label and extra, holdout rows with the mapped label only."""
    options = dict(sep="\t", quote='"', escape='"', emptyValue="")
    train.select("text", "label", "extra").write.mode("overwrite").options(**options).csv(f"{path}/train")
    holdout.select("text", "mapped_label").write.mode("overwrite").options(**options).csv(f"{path}/holdout")


def write_generated(df: DataFrame, path: str) -> None:
    df.select("text", "true_label").write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
