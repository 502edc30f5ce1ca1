import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.operators import curation as cu
from wardline.operators import evaluation as ev
from wardline.operators import generation as ge
from wardline.operators import labels as lb
from wardline.operators import splits as sp


def rows(df):
    return [tuple(r) for r in df.collect()]


def source(spark, data):
    return spark.createDataFrame(data, "text string, label string, extra string, seq long")


def test_feedback_beats_model_label_beats_seed(spark):
    corpus = source(spark, [("a", "Not_offensive", "x", 1), ("b", "Profanity", "feedback", 2), ("c", "Profanity", None, 3)])
    chat = source(spark, [("a", "Off_target_ind", "user_chat", 1), ("b", "Not_offensive", "user_chat", 9)])
    feedback = source(spark, [("a", "Profanity", "user_feedback", 0)])
    union = cu.union_sources({"corpus": corpus, "user_chat": chat, "feedback": feedback, "absent": None} | {"absent": None})
    kept = {r["text"]: r["label"] for r in cu.keep_last(union, ["text"], ["source_rank", "seq"]).collect()}
    assert kept == {"a": "Profanity", "b": "Profanity", "c": "Profanity"}


def test_keep_last_and_first_on_one_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    last = {r["k"]: r["id"] for r in cu.keep_last(df, ["k"], ["id"]).collect()}
    first = {r["k"]: r["id"] for r in cu.keep_first(df, ["k"], ["id"]).collect()}
    assert last["hot"] == 19998 and first["hot"] == 0 and len(last) == len(first) == 1 + 20000 - 6667


def test_labels(spark):
    dim = lb.label_dim(spark)
    df = spark.createDataFrame([(raw,) for raw, *_ in lb.LABELS] + [("nope",), (None,)], "label string")
    mapped = lb.label_ids(lb.map_labels(df, dim), dim)
    assert {(r["label"], r["mapped_label"], r["label_id"]) for r in mapped.collect()} == {x[:3] for x in lb.LABELS}


def brute_split(counts, frac):
    total = sum(counts.values())
    train = total - math.ceil(total * frac)
    floors = {k: n * train // total for k, n in counts.items()}
    order = sorted(counts, key=lambda k: (-(counts[k] * train % total), k))
    extra = set(order[: train - sum(floors.values())])
    return {k: n - floors[k] - (k in extra) for k, n in counts.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_split_is_exact_disjoint_and_reproducible(spark, parts):
    data = [(f"t{i}", "big" if i % 3 else f"c{i % 4}") for i in range(3001)] + [("lonely", "single")]
    df = spark.createDataFrame(data, "text string, label string").repartition(parts)
    train, held = sp.stratified_split(df, "text", "label", 0.2, 99)
    got_train, got_held = rows(train.select("text", "label")), rows(held.select("text", "label"))
    assert sorted(got_train + got_held) == sorted(data)
    sizes = brute_split(Counter(label for _, label in data), 0.2)
    want = []
    for label, k in sizes.items():
        ranked = sorted((hashlib.md5(f"99:{t}".encode()).hexdigest(), t) for t, c in data if c == label)
        want += [(t, label) for _, t in ranked[:k]]
    assert sorted(got_held) == sorted(want)
    assert len(got_held) == math.ceil(0.2 * len(data))


def test_plain_split(spark):
    train, held = sp.split(spark.range(101).withColumnRenamed("id", "k"), "k", 0.05)
    assert (train.count(), held.count()) == (95, 6)


def test_shuffle_depends_on_seed_and_key_only(spark):
    order = lambda parts, seed: [r[0] for r in cu.shuffle(spark.range(50).repartition(parts), "id", seed).collect()]
    assert order(1, 7) == order(5, 7) != order(1, 8)
    assert sorted(order(1, 7)) == list(range(50))


def test_leakage_ignores_case_and_outer_space(spark):
    test = spark.createDataFrame([("Hi ",), ("Hi ",), ("new",)], "text string")
    train = spark.createDataFrame([("hi",), (None,)], "text string")
    assert rows(cu.overlap(test, train)) == [("Hi ",), ("Hi ",)]
    assert rows(cu.remove_overlap(test, train)) == [("new",)]
    assert rows(cu.intersect_texts(test, train)) == [("hi",)]


def test_metrics_against_brute_force(spark):
    pairs = [("Offensive", "Offensive")] * 5 + [("Offensive", "Not_offensive")] * 3 + [("Not_offensive", "Offensive")] + [("Not_offensive",) * 2] * 11
    df = spark.createDataFrame(pairs, "t string, p string")
    m = ev.binary_metrics(df, "t", "p", "Offensive").first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.8, round(5 / 6, 6), 0.625, round(2 * (5 / 6) * 0.625 / (5 / 6 + 0.625), 6))
    assert rows(ev.confusion_matrix(df, "t", "p", ["Not_offensive", "Offensive", "Other"])) == [
        ("Not_offensive", 11, 1, 0), ("Offensive", 3, 5, 0), ("Other", 0, 0, 0),
    ]
    report = {r["label"]: r for r in ev.class_report(df, "t", "p").collect()}
    assert report["accuracy"]["f1"] == 0.8 and report["accuracy"]["precision"] is None
    assert report["macro avg"]["recall"] == round((0.625 + 11 / 12) / 2, 6)
    assert report["weighted avg"]["support"] == 20


def test_metrics_are_zero_not_null(spark):
    df = spark.createDataFrame([("Offensive", "Not_offensive")], "t string, p string")
    m = ev.binary_metrics(df, "t", "p", "Offensive").first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)


def test_histogram_bins(spark):
    data = [(True, s) for s in (0.0, 0.05, 0.5, 1.0, 1.0)] + [(False, 0.7)]
    got = ev.score_histogram(spark.createDataFrame(data, "ok boolean, s double"), "s", "ok").collect()
    full = {(r["ok"], r["bin"]): r["n"] for r in got if r["n"]}
    assert full == {(True, 0): 1, (True, 1): 1, (True, 10): 1, (True, 19): 2, (False, 10): 1}
    assert len(got) == 40


def test_generator_counts_and_truth(spark):
    df = ge.generate(spark, 500, ["{a} x {b}", "{b}"], {"a": ["1", "2"], "b": ["p", "q", "r"]}, "Not_offensive")
    texts = [r["text"] for r in df.collect()]
    assert len(texts) == 500 and set(texts) == {f"{a} x {b}" for a in "12" for b in "pqr"} | set("pqr")
    train = spark.createDataFrame([("P",)], "text string")
    assert "p" not in {r["text"] for r in ge.unseen(df, train).collect()}


def test_rare_classes_go(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "mapped_label string")
    assert rows(cu.drop_rare(df)) == [("a",), ("a",)]
    assert rows(cu.label_distribution(df)) == [("a", 2), ("b", 1)]


def test_digest_joins_keep_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, "Alpha"), (2, " alpha "), (3, None), (4, "beta"), (4, "beta")], "id int, text string")
    b = spark.createDataFrame([("ALPHA",), (None,), ("beta",)], "text string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(cu.overlap(a, b)) == [1, 2, 4, 4] and ids(cu.remove_overlap(a, b)) == [3]
    assert ids(cu.subtract_texts(a, b)) == [1, 2, 3] and cu.subtract_texts(a, b).columns == ["id", "text"]


def test_scratch_scope_deletes_what_was_written_inside(spark):
    from pathlib import Path

    from wardline.session import materialise, scratch_scope

    with scratch_scope(spark):
        path = materialise(spark.range(5), "inside").inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).parent.exists()
    kept = materialise(spark.range(5), "outside").inputFiles()[0].removeprefix("file://")
    assert Path(kept).exists()
