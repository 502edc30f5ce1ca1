import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.plans import counting as ct

ROWS = "text string, label string, bucket int"


def texts(n, seed):
    rng = random.Random(seed)
    words = ["apple", "Éclair", "bread", "x1", "under_score", "salt", "7"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", ",", "!?"]) for _ in range(rng.randrange(12))), rng.choice("abc"), 5) for _ in range(n)]
    return [*rows, (None, "a", 1), ("no label", None, 1), ("", "c", 1), ("one", "b", 1), rows[0], rows[0]]


def state(df):
    return {(r["label"], r["bucket"]): (r["docs"], r["terms"]) for r in df.collect()}


def plain(rows, bucket_of):
    found = defaultdict(lambda: [0, 0])
    for text, label, _ in rows:
        if text is None or label is None:
            continue
        words = __import__("re").findall(r"\w+", text.lower())
        terms = Counter(bucket_of[t] for t in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
        for bucket, n in [(ct.WHOLE, sum(terms.values())), *terms.items()]:
            found[(label, bucket)][0] += 1
            found[(label, bucket)][1] += n
    return {k: tuple(v) for k, v in found.items()}


def test_sums_against_a_plain_version(spark):
    import hashlib

    class Buckets(dict):
        def __missing__(self, term):
            return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 64

    rows = texts(200, 1)
    assert state(ct.count_terms(spark.createDataFrame(rows, ROWS), 64)) == plain(rows, Buckets())


def test_training_goes_on_from_what_was_saved(spark, tmp_path):
    a, b, c = (spark.createDataFrame(texts(80, seed), ROWS) for seed in (1, 2, 3))
    path = str(tmp_path / "sums")
    assert ct.load_sums(spark, path).count() == 0
    ct.go_on_training(a, path, 0)
    ct.go_on_training(b, path, 1)
    ct.go_on_training(b, path, 1)  # the same batch again
    ct.go_on_training(spark.createDataFrame([], ROWS), path, 2)
    found = ct.go_on_training(c, path, 3)
    assert state(found) == state(ct.count_terms(a.unionByName(b).unionByName(c).repartition(5)))
    once = ct.class_weights(found, 1.0)
    whole = ct.class_weights(ct.count_terms(c.unionByName(a).unionByName(b)), 1.0)
    assert once[:2] == whole[:2] and sorted(map(str, once[2].collect())) == sorted(map(str, whole[2].collect()))


def test_a_stream_trains_the_same(spark, tmp_path):
    rows, path = str(tmp_path / "rows"), str(tmp_path / "sums")
    whole = spark.createDataFrame(texts(60, 4), ROWS).repartition(3)
    whole.write.parquet(rows)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(rows)
    ct.stream_training(stream, path, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert len(ct._versions(spark, path)) > 1
    assert state(ct.load_sums(spark, path)) == state(ct.count_terms(whole))


def test_scores(spark):
    rows = [("red wine and cheese", "food", 0)] * 900 + [("red car and wheel", "cars", 0)] * 700 + [("and then some", "cars", 0)] * 200
    sums = ct.count_terms(spark.createDataFrame(rows, ROWS))
    asked = spark.createDataFrame([(1, "Cheese!", 9), (2, "my CAR", 9), (3, None, 9), (4, "", 9), (5, "and", 9), (6, "cheese " * 4000, 9)], "id long, text string, scores int").drop("scores")
    found = {r["id"]: {s["label"]: s["score"] for s in r["scores"]} for r in ct.count_scores(asked, "id", "text", sums).collect()}
    assert all(math.isclose(sum(s.values()), 1) for s in found.values())
    assert found[1]["food"] > 0.9 and found[2]["cars"] > 0.9
    assert found[3] == found[4] == found[5] == {"cars": 0.5, "food": 0.5}  # "and" tells nothing apart
    assert math.isclose(found[6]["food"], ct_odds(rows, "cheese", "cheese cheese"), rel_tol=1e-9)
    with pytest.raises(ValueError):
        ct.count_scores(asked, "id", "text", spark.createDataFrame([], ct.STATE))


def ct_odds(rows, *terms):
    """Which terms a text has counts, not how often: the weight of one known term."""
    food = sum(label == "food" for _, label, _ in rows)
    inside = sum(terms[0] in text and label == "food" for text, label, _ in rows) + 0.5
    outside = 0.5
    odds = math.log(inside / (food + 1)) - math.log(outside / (len(rows) - food + 1))
    return 1 / (1 + math.exp(-odds - math.log(food / (len(rows) - food))))


def test_holdout_beats_the_larger_class(spark):
    import os

    from wardline.bindings import registered

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    found = registered()[0]["train_predict"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, safe, n = found.agg(F.count_if((F.col("offensive") > 0.5) == (F.col("toxic") == 1)), F.count_if(F.col("toxic") == 0), F.count("*")).first()
    assert n > 50 and right > safe


def test_rows_that_share_an_id_are_counted_together(spark):
    rows = [(1, "a b a"), (2, "a"), (2, "a a"), (None, "b"), (None, "b b"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    slot = {w: ct_bucket for w, ct_bucket in df.sparkSession.createDataFrame([("a",), ("b",)], "w string").select("w", F.get(ct.term_buckets(F.col("w")), 0)).collect()}
    for given in (df, ct.hashed(df, "text")):
        counted = ct.term_counts(given, "id", "text")
        got = {(r["id"], r["bucket"]): r["tf"] for r in counted.collect()}
        assert {k: n for k, n in got.items() if k[1] in slot.values()} == {
            (1, slot["a"]): 2, (1, slot["b"]): 1, (2, slot["a"]): 3, (None, slot["b"]): 3,
        }
        # Texts with an id of their own go by the shuffle.
        assert "Union" in counted._jdf.queryExecution().executedPlan().toString()


def spelled(df, buckets):
    """The sums as SQL functions on strings give them, one term at a time."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = df.filter("text IS NOT NULL AND label IS NOT NULL").withColumn("w", words)
    terms = rows.select("row", "label", F.explode(F.concat("w", F.coalesce(pairs, F.array().cast("array<string>")))).alias("t"))
    bucket = (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % buckets).cast("int").alias("bucket")
    cells = terms.groupBy("row", "label", bucket).agg(F.count("*").alias("n")).groupBy("label", "bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"))
    whole = rows.join(terms.groupBy("row").count(), "row", "left").groupBy("label", F.lit(ct.WHOLE).alias("bucket"))
    return cells.unionByName(whole.agg(F.count("*").alias("docs"), F.coalesce(F.sum("count"), F.lit(0)).alias("terms")))


def test_buckets_are_those_of_single_terms(spark):
    rng = random.Random(8)
    units = [chr(c) for c in range(1, 0x10400) if not 0xD800 <= c < 0xE000]
    sizes = [" ".join("é" * rng.randrange(4) + "x" * n for n in range(at, at + 30)) for at in range(0, 150, 29)]
    mixed = ["".join(rng.choice("ab, éßİΣ日𝒳😀_7\n\0") for _ in range(rng.randrange(60))) for _ in range(300)]
    every = ["".join(units[i : i + 700]) for i in range(0, len(units), 700)]
    rows = [(i, t, f"label {i % (3 * ct.HELD)}") for i, t in enumerate([*sizes, *mixed, *every, "", " ", " a", "a ", None, "ab " * 400000, "y" * 300000])]
    df = spark.createDataFrame([*rows, (-1, "no label", None)], "row long, text string, label string").repartition(3)
    for given in (df, ct.hashed(df, "text", 1 << 18)):
        assert state(ct.count_terms(given)) == state(spelled(df, 1 << 18))


def test_terms_are_hashed_in_batches_and_not_shuffled_one_by_one(spark):
    df = spark.createDataFrame([("a b", "x", 1)], ROWS)
    sums = ct.count_terms(df)
    scored = ct.count_scores(df.select("bucket", "text"), "bucket", "text", sums)
    for found in (sums, scored):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "regexp_extract_all" not in plan


def test_scores_of_rows_that_share_an_id(spark):
    rows = [("red wine", "food", 0)] * 900 + [("red car", "cars", 0)] * 700
    sums = ct.count_terms(spark.createDataFrame(rows, ROWS))
    asked = spark.createDataFrame([(1, "wine"), (1, "car car"), (2, "wine"), (2, "Wine, wine"), (3, "red"), (None, "wine")], "id long, text string")
    found = {(r["id"], r["text"]): [x - math.log(n / 1600) for x, n in zip(r["log_odds"], (700, 900), strict=True)] for r in ct.count_scores(asked, "id", "text", sums).collect()}
    assert len(found) == 6 and found[(3, "red")] == found[(None, "wine")] == [0, 0]
    # As before, an id has what all its rows add up to.
    assert found[(2, "wine")] == found[(2, "Wine, wine")] and found[(1, "wine")] == found[(1, "car car")]
    assert found[(2, "wine")][1] > 0 > found[(2, "wine")][0]
