"""A training corpus from raw documents: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's input.  All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import language_id, packing, quality_rules, sentence_dedup
from wardline.llm.jaccard_join import jaccard_join
from wardline.llm.queries import tokenizer_path
from wardline.session import scratch_dir, scratch_scope


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.language_filter(docs)


def well_formed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; rows with a null doc_id stay.

    Rows that are equal in all columns are one document and leave one row.
    """
    copies = jaccard_join(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("copy"), F.count("*").alias("rows"))
    marks = copies.filter("doc_id IS NOT NULL AND (copy OR rows > 1)").select("doc_id", "copy").withColumnRenamed("doc_id", "id of mark")
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id of row"))
    found = found.join(marks, F.col("id of row") == F.col("id of mark"), "left").filter("NOT coalesce(copy, false)")
    single = found.filter("copy IS NULL").select("row.*")
    return single.unionByName(found.filter("NOT copy").select("row.*").dropDuplicates())


def fresh_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return sentence_dedup.sentence_dedup(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 4096 tokens."""
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return packing.best_fit_packing(pieces.drop("ids"))


STAGES = [
    ("language", recognised),
    ("quality", well_formed),
    ("near duplicates", distinct_documents),
    ("repeated passages", fresh_sentences),
    ("packing", packed),
]

# The language model and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage writes on its way is deleted with it; its result stays for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
