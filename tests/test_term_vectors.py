import random

import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from wardline.plans import scoring as so
from wardline.plans import term_vectors as tv
from wardline.plans import training as tr


def texts():
    rng = random.Random(3)
    units = [chr(c) for c in range(1, 0x10400) if not 0xD800 <= c < 0xE000]
    every = ["".join(units[i : i + 3000]) for i in range(0, len(units), 2990)]
    mixed = ["".join(rng.choice("ab, éßİΣ日本😀𝒳_7\n") for _ in range(rng.randrange(30))) for _ in range(300)]
    return [*every, *mixed, "", " ", "a", "ab", "abc", "ΑΣ ΑΣΑ", "ab " * 12000, "x" * 9000, "日é" * 20000]


@pytest.mark.parametrize("features", [1 << 14, 1000])
def test_vectors_are_those_of_the_string_stages(spark, features):
    low = SQLTransformer(statement="SELECT *, lower(trim(text)) AS _cut FROM __THIS__")
    words = RegexTokenizer(inputCol="_cut", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")
    chars = RegexTokenizer(inputCol="_cut", outputCol="_chars", pattern="", minTokenLength=1)
    grams = [NGram(n=2, inputCol="_words", outputCol="_pairs"), NGram(n=3, inputCol="_chars", outputCol="_triples")]
    counts = [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features) for c in ("_words", "_pairs", "_triples")]
    together = VectorAssembler(inputCols=[c.getOutputCol() for c in counts], outputCol="strings")
    arrays = tv.TermVectors(inputCols=["_cut", "_words"], outputCol="arrays", numFeatures=features)
    rows = spark.createDataFrame([(x,) for x in texts()], "text string").repartition(4)
    stages = PipelineModel([low, words, chars, *grams, *counts, together, arrays])
    found = stages.transform(rows).select("text", "strings", "arrays").collect()
    assert len(found) == len(texts())
    for row in found:
        assert row["strings"].toArray().tolist() == row["arrays"].toArray().tolist(), ascii(row["text"][:40])


def test_batches_of_texts():
    given = ["ab cd", None, "", "x"] * 9000
    vectors = tv.term_vectors(pa.array(given), pa.array(given), 64).to_pylist()
    assert vectors[:4] * 9000 == vectors
    assert vectors[1] is None and vectors[2]["indices"] == [] and sum(vectors[0]["values"]) == 2 + 1 + 3
    assert len(tv.term_vectors(pa.array([], pa.string()), pa.array([], pa.string()), 64)) == 0


def test_more_texts_than_leave_together(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "concat('a b', id % 7) AS t", "array('a', concat('b', id % 7)) AS w")
    found = tv.TermVectors(inputCols=["t", "w"], outputCol="v", numFeatures=64).transform(rows)
    assert found.columns == ["id", "v"]
    by_id = {r["id"]: r["v"] for r in found.collect()}
    assert len(by_id) == 3000 and all(by_id[i] == by_id[i % 7] and by_id[i].values.sum() == 2 + 1 + 2 for i in by_id)


def test_a_training_cuts_its_texts_once(spark):
    """The weights and the regression read written counts; a score predicts once for all labels."""
    counter = spark.sparkContext.accumulator(0)

    def seen(text):
        counter.add(1)
        return text

    texts = [(f"you {'moron' if i % 2 else 'dear'} number {i}", 3 if i % 2 else 0) for i in range(40)]
    rows = spark.createDataFrame(texts, "text string, label_id int").withColumn("text", F.udf(seen)("text"))
    model = tr.fit_classifier(rows, features=1 << 8, max_iter=3)
    assert counter.value == 40
    scored = so.pipeline_scorer(model)(spark.createDataFrame(texts[:4], "text string, label_id int"), "text")
    found = [{s["label"]: s["score"] for s in r["scores"]} for r in scored.orderBy("text").collect()]
    assert all(len(x) == 5 and abs(sum(x.values()) - 1) < 1e-9 and x["Off_target_ind"] == 0 for x in found)
    assert [x["Profanity"] > 0.5 for x in found] == [False, False, True, True]
