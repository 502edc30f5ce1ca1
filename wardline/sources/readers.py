"""Readers for the files the engine takes in.  Schemas are explicit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import schemas
from wardline.sources.verified import read_pairs


def _csv(spark: SparkSession, path: str, schema: T.StructType, sep: str, multi_line: bool, header: bool = False) -> DataFrame:
    return (
        spark.read.schema(schema)
        .options(sep=sep, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE", header=header)
        .csv(path)
    )


# A task counts its rows below this number.
_TASK_ROWS = 1 << 33


def _in_order(rows: DataFrame, path: str) -> DataFrame:
    """Add ``seq``: files by time of change, then path; then the order within the file.

    A split begins at its byte offset, and each of its rows takes a byte at
    least, so rows are counted on from there.  Files begin where all files
    before them end, with room for the rows of a task between; that leaves
    numbers for half a billion files.  The files are listed, not read, for it.
    """
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(_TASK_ROWS - 1)
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": place})
    listed = rows.sparkSession.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_changed"), F.col("_metadata.file_size").alias("_size")
    )
    # One row per file.
    before = Window.orderBy("_changed", "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = listed.select("_file", F.coalesce(F.sum(F.col("_size") + _TASK_ROWS).over(before), F.lit(0)).alias("_begin"))
    # The driver holds the list of files as it is; rows, texts and all, are not shuffled to meet it.
    return rows.join(F.broadcast(files), "_file").withColumn("seq", F.col("_begin") + F.col("_row")).drop("_file", "_row", "_begin")


def _or_empty(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_corpus(
    spark: SparkSession, path: str, source: str = "corpus", keep_long: bool = False, multi_line: bool = True
) -> DataFrame:
    """Headerless TSV ``text, label, extra`` plus ``source`` and ``seq`` (order of files and rows).

    Rows with too few fields are padded with null; rows with too many are
    dropped unless ``keep_long`` (the override map takes them).  Texts may hold
    quoted line breaks, which makes a file unsplittable: keep a large corpus in
    many files, or say ``multi_line=False`` if it has no such texts.
    """
    schema = T.StructType(schemas.CORPUS.fields + [T.StructField("_over", T.StringType())])
    rows = _csv(spark, path, schema, "\t", multi_line)
    if not keep_long:
        rows = rows.filter(F.col("_over").isNull())
    return _in_order(rows.drop("_over"), path).select(*(f.name for f in schemas.CORPUS), F.lit(source).alias("source"), "seq")


def read_feedback(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Feedback log (6 or 7 comma-separated fields) as corpus rows; a missing file is empty."""
    def read() -> DataFrame:
        rows = _in_order(_csv(spark, path, schemas.FEEDBACK, ",", multi_line), path)
        return rows.select("text", "label", F.lit("user_feedback").alias("extra"), F.lit("feedback").alias("source"), "seq")

    empty = T.StructType(schemas.CORPUS.fields + [T.StructField("source", T.StringType()), T.StructField("seq", T.LongType())])
    return _or_empty(read, spark, empty)


def read_audit(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Feedback log with all its fields."""
    return _or_empty(lambda: _csv(spark, path, schemas.FEEDBACK, ",", multi_line), spark, schemas.FEEDBACK)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message history, a JSON array per file, with ``seq`` as order; a bad or missing file is empty."""
    def read() -> DataFrame:
        reader = spark.read.schema(schemas.MESSAGE).options(multiLine=True, mode="DROPMALFORMED")
        return _in_order(reader.json(path), path)

    return _or_empty(read, spark, T.StructType(schemas.MESSAGE.fields + [T.StructField("seq", T.LongType())]))


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """Verified labels, one JSON object per file, as ``(text, label)``; files are read in splits."""
    return read_pairs(spark, path)


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, T.StructType.fromDDL("text string, true_label string"), ",", True, header=True)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon table ``(term, pos)`` as CSV with header."""
    return _csv(spark, path, schemas.LEXICON, ",", False, header=True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rewrite rules ``(stage, ord, pattern, replacement)`` as CSV with header."""
    return _csv(spark, path, schemas.RULES, ",", False, header=True)
