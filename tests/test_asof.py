import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import actions as ac
from wardline.operators.asof import as_of

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def moment(second):
    return START + dt.timedelta(seconds=second)


def plain(points, versions):
    found = {}
    for key, at in points:
        if key is None or at is None:
            continue
        mine = sorted((v[1], v[2], v[3]) for v in versions if v[0] == key and v[1] is not None and v[1] <= at)
        found[(key, at)] = mine[-1][2] if mine else None
    return found


@pytest.mark.parametrize("run_rows", [1_000_000, 20])
def test_as_of_against_a_plain_version(spark, run_rows):
    rng = random.Random(3)
    keys = ["hot"] * 8 + [f"k{i}" for i in range(12)] + ["never", None]
    points = [(rng.choice(keys), moment(rng.randrange(400))) for _ in range(900)] + [("hot", None), ("hot", moment(-5)), ("k1", moment(10**6))]
    versions = [(rng.choice(keys[:-2]), moment(rng.randrange(400)), i, f"v{i}") for i in range(500)] + [(None, moment(3), 900, "x"), ("k2", None, 901, "x")]
    p = spark.createDataFrame([(k, t, "other") for k, t in points], "id string, ts timestamp, _value string")
    v = spark.createDataFrame([(*r, "other") for r in versions], "id string, ts timestamp, n long, label string, _run string")
    found = as_of(p, v, "id", "ts", "n", ["label"], run_rows).collect()
    got = {(r["id"], r["ts"].replace(tzinfo=dt.UTC) if r["ts"].tzinfo is None else r["ts"]): r["label"] for r in found}
    assert len(found) == len(got)
    want = plain(points, versions)
    assert got == want and None in want.values()


def test_a_message_with_very_many_versions_is_cut_into_runs(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    n = 10_000
    log = spark.range(n).select(
        F.lit("m").alias("id"), F.timestamp_seconds(F.col("id") * 10 + 1_700_000_000).alias("ts"), F.col("id").alias("seq"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("label"), (F.col("id") / n).alias("offensive_score"),
    )
    log = log.unionByName(log.limit(1).withColumns({"id": F.lit("quiet"), "label": F.lit("once")}))
    asked = spark.range(3_000).select(F.lit("m").alias("id"), F.timestamp_seconds(F.col("id") * 37 + 1_699_999_990).alias("ts"))
    held = as_of(asked, log, "id", "ts", "seq", ["label", "seq"], run_rows=500)
    rows = held.select(F.unix_timestamp("ts").alias("s"), "seq").collect()
    starts = [i * 10 + 1_700_000_000 for i in range(n)]
    assert len(rows) == 3_000
    for s, seq in rows:
        at = bisect.bisect_right(starts, s) - 1
        assert seq == (at if at >= 0 else None)
    plan = held._jdf.queryExecution().toString()
    assert "Window [last(_value" in plan and "[_key#" in plan and ", _run#" in plan  # no window over the whole message


def test_audit_keeps_one_row_per_action_and_the_prediction_of_its_time(spark):
    msgs = spark.createDataFrame([("1", "hello", "late", 0.1)], "id string, text string, label string, offensive_score double")
    log = spark.createDataFrame(
        [("1", moment(10), 1, "Profanity", 0.9), ("1", moment(20), 2, "Not_offensive", 0.2), ("1", moment(20), 3, "Profanity", 0.8), ("2", moment(0), 4, "x", 1.0)],
        "id string, ts timestamp, seq long, label string, offensive_score double",
    )
    kinds = [("report", None), ("classify", "hate_speech"), ("classify", " Not_Hate_Speech"), ("classify", "maybe"), ("reveal", None)]
    log_of = [(i, moment(t), "1", k, v) for i, (t, (k, v)) in enumerate([(5, kinds[0]), (10, kinds[1]), (15, kinds[2]), (20, kinds[0]), (25, kinds[1]), (9, kinds[3]), (9, kinds[4])])]
    actions = spark.createDataFrame([*log_of, (9, moment(30), "2", "report", None)], "seq long, ts timestamp, message_id string, kind string, value string")
    found = ac.audit_as_of(actions, msgs, log).orderBy("seq")
    assert [(r.seq, r.model_label, r.offensive_score, r.action) for r in found.collect()] == [
        (0, None, None, None), (1, "Profanity", 0.9, "user_classify:hate_speech"), (2, "Profanity", 0.9, "user_classify:not_hate_speech"),
        (3, "Profanity", 0.8, None), (4, "Profanity", 0.8, "user_classify:hate_speech"),
    ]
    assert found.columns == ac.audit_rows(actions, msgs).columns


def test_texts_are_read_once_for_an_audit(spark, tmp_path):
    spark.createDataFrame([("1", "hi", "Profanity", 0.5), ("2", "yo", "x", 0.1)], "id string, text string, label string, offensive_score double").write.parquet(str(tmp_path / "m"))
    msgs = spark.read.parquet(str(tmp_path / "m"))
    rows = [(1, moment(5), "1", "report", None), (2, moment(6), "1", "classify", "hate_speech"), (3, moment(7), "9", "report", None), (4, moment(8), "2", "reveal", None)]
    acts = spark.createDataFrame(rows, "seq bigint, ts timestamp, message_id string, kind string, value string")
    log = spark.createDataFrame([("1", moment(6), 1, "late", 0.9)], "id string, ts timestamp, seq bigint, label string, offensive_score double")
    for audit, labels in ((ac.audit_as_of(acts, msgs, log), [None, "late"]), (ac.audit_rows(acts, msgs), ["Profanity"] * 2)):
        assert audit._jdf.queryExecution().executedPlan().toString().count("text:string") == 1
        assert [(r["seq"], r["text"], r["model_label"]) for r in audit.orderBy("seq").collect()] == [(1, "hi", labels[0]), (2, "hi", labels[1])]
