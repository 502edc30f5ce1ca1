import json
import os
import time

from pyspark.sql import functions as F

from wardline.bindings import action_queries
from wardline.bindings import base
from wardline.operators import actions as ac
from wardline.operators import labels as lb
from wardline.operators import messages as ms
from wardline.operators import review as rv
from wardline.operators import users as us
from wardline.plans import classify as cl
from wardline.plans import scoring as so
from wardline.plans import training as tr
from wardline.sources import readers as rd
from wardline.sources import sinks as sk
from wardline.streaming import streams as st


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- files ----------------------------------------------------------------------


def test_ragged_corpus(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text('a\tProfanity\tfeedback\nshort\tNot_offensive\nlong\tx\ty\tz\n"two\nlines ""q"""\tx\tseed\n', encoding="utf-8")
    got = rd.read_corpus(spark, str(path)).orderBy("seq")
    assert rows(got.select("text", "label", "extra")) == [
        ("a", "Profanity", "feedback"), ("short", "Not_offensive", None), ('two\nlines "q"', "x", "seed"),
    ]
    assert rd.read_corpus(spark, str(path), keep_long=True).count() == 4


def test_feedback_log(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("2024-01-01T10:00:00,1,hi,Profanity,0.5,Not_offensive\n2024-01-02T10:00:00,2,yo,Not_offensive,,,user_classify:x\n", encoding="utf-8")
    assert rows(rd.read_feedback(spark, str(path)).orderBy("seq").select("text", "label", "extra")) == [
        ("hi", "Profanity", "user_feedback"), ("yo", "Not_offensive", "user_feedback"),
    ]
    assert [r["action"] for r in rd.read_audit(spark, str(path)).collect()] == [None, "user_classify:x"]
    missing = rd.read_feedback(spark, str(tmp_path / "none.csv"))
    assert missing.count() == 0 and missing.columns == ["text", "label", "extra", "source", "seq"]


def test_history_and_verified(spark, tmp_path):
    history = tmp_path / "h.json"
    history.write_text(json.dumps([{"id": "1", "text": "a", "all_scores": {"x": 0.5}}, {"id": "2", "text": "b"}]), encoding="utf-8")
    got = rd.read_messages(spark, str(history)).orderBy("seq")
    assert rows(got.select("id", "text", "all_scores")) == [("1", "a", {"x": 0.5}), ("2", "b", None)]
    (tmp_path / "bad.json").write_text("[{", encoding="utf-8")
    assert rd.read_messages(spark, str(tmp_path / "bad.json")).count() == 0
    assert rd.read_messages(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "v.json").write_text('{"Hi": "Profanity", "hi": "Not_offensive"}', encoding="utf-8")
    assert sorted(rows(rd.read_verified(spark, str(tmp_path / "v.json")))) == [("Hi", "Profanity"), ("hi", "Not_offensive")]


def test_verified_objects_are_read_in_splits(spark, tmp_path):
    """Pairs that lie in several splits, keys longer than ``from_json`` takes, and files that only it reads."""
    good = {"k" * 50_001: "long", 'q"\\': "a,b:{}", "": None, "n": 1.5, "é🎈": '\\"', "esc" + '"' * 41: "\n"}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text('{"x": {"y": [1]}, "z": "w"} after', encoding="utf-8")
    (tmp_path / "c.json").write_text('{"lost": "a", "cut": ', encoding="utf-8")
    (tmp_path / "d.json").write_text('{"lost": "a",}', encoding="utf-8")
    (tmp_path / "e.json").write_text(" { } ", encoding="utf-8")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, ("2000b", "1b"), strict=True):
            spark.conf.set(name, value)
        found = rd.read_verified(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 20
        got = {r["text"]: r["label"] for r in found.collect()}
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    assert got == good | {"n": "1.5", "x": '{"y":[1]}', "z": "w"}


def test_verified_objects_are_written_pair_by_pair(spark, tmp_path, monkeypatch):
    docs = [(i, f'text "{i}"', f"s{i % 2}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 3 % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(action_queries, "scratch_dir", lambda spark, name: str(tmp_path / name))
    found = action_queries.read_verified(spark, str(tmp_path)).collect()
    assert sorted(found) == sorted((text, "Profanity" if i % 3 == 1 else "Not_offensive") for i, text, _ in docs)
    for source in ("s0", "s1"):
        (file,) = (tmp_path / "verified" / f"source={source}").glob("part-*")
        whole = file.read_text(encoding="utf-8")
        assert len(json.loads(whole)) == len(whole.strip().split("\n")) == 20


def test_user_chat_is_saved_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 3)], "text string, label string, seq long")
    for _ in range(2):
        sk.append_user_chat(df, str(tmp_path / "chat"))
    assert sorted(rows(spark.read.parquet(str(tmp_path / "chat")).select("text", "label"))) == [("a", "y"), ("b", "z")]


# -- actions and review ------------------------------------------------------------


def test_message_state(spark):
    msgs = spark.createDataFrame([("1", "Bad"), ("2", "ok")], "id string, text string").withColumns(
        {"offensive_score": F.lit(0.9), "label": F.lit("Profanity")}
    )
    log = [
        (1, None, "1", "reveal", None), (2, None, "1", "reveal", None), (3, None, "1", "reveal", None),
        (4, None, "2", "reveal", None), (5, None, "2", "reveal", None), (6, None, "2", "report", None),
        (7, None, "1", "classify", " Hate_Speech"), (8, None, "1", "classify", "not_hate_speech"), (9, None, "1", "classify", "huh"),
        (10, None, "9", "report", "x"),
    ]
    actions = spark.createDataFrame(log, "seq long, ts timestamp, message_id string, kind string, value string")
    state = {r["id"]: (r["reported"], r["revealed"], r["user_classification"]) for r in ac.message_state(msgs, actions).collect()}
    assert state == {"1": (False, True, "not_hate_speech"), "2": (True, False, None)}
    assert rows(ac.report(actions, msgs)) == [("ok", "Offensive_Untargetede", "feedback", 6)]
    assert [r[1] for r in ac.user_classify(actions, msgs).orderBy("seq").collect()] == ["Offensive_Untargetede", "Not_offensive"]
    assert {(r["seq"], r["reason"]) for r in ac.rejected_feedback(actions, msgs).collect()} == {(9, "bad classification"), (10, "message not found")}
    assert ac.valid_feedback(actions, msgs).count() == 8
    assert ac.audit_rows(actions, msgs).filter("action = 'user_classify:hate_speech'").count() == 1


def test_long_clip_is_joined_in_order(spark):
    segments = spark.range(5000).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("seg_no"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("text"))
    got = rows(ms.assemble_transcripts(segments.repartition(5)))
    assert got == [("c", " ".join(str(i) for i in range(5000)))]


def test_review(spark):
    items = spark.createDataFrame([(i, f"t{i}", "Profanity" if i % 2 else "Not_offensive") for i in range(8)], "seq long, text string, ai_label string")
    verified = spark.createDataFrame([("t0", "Not_offensive"), ("t1", "Not_offensive"), ("gone", "Profanity")], "text string, label string")
    assert rows(rv.review_progress(items, verified)) == [(8, 3, 6, 38)]
    skipped = spark.createDataFrame([(2,)], "seq long")
    assert [r["seq"] for r in rv.next_item(items, verified, skipped, 2).collect()] == [3, 4]
    assert rows(rv.review_metrics(items, verified)) == [(2, 50.0, 0.0, 0.0, 0.0)]


# -- streams: several micro-batches give what one batch gives -------------------------


def incoming(spark, tmp_path):
    data = [(str(i), i, f"r{i % 3}", t, u, False, True) for i, (t, u) in enumerate(
        [("hello all", "Ann"), ("ann is a moron", "Bob"), ("bob hey", "Ann"), ("hello all", "Cyd"), ("  ", "Dan"), ("hey", "Guest")] * 4
    )]
    df = spark.createDataFrame(data, "id string, seq long, room string, text string, username string, is_audio boolean, guard_on boolean")
    df = df.withColumn("client_id", F.lit("c"))
    path = str(tmp_path / "in")
    for low in range(0, len(data), 6):  # files in order of arrival
        df.filter((F.col("seq") >= low) & (F.col("seq") < low + 6)).coalesce(1).write.mode("append").parquet(path)
    return df, st.stream_messages(spark, path, df.schema, maxFilesPerTrigger=1)


def test_stream_classify_equals_batch(spark, tmp_path):
    df, stream = incoming(spark, tmp_path)
    settings = cl.ClassifierSettings(base.normaliser_settings(spark, phonetic=False), so.lexicon_scorer(base.TERMS), room="room")
    out, users, overrides = (str(tmp_path / n) for n in ("out", "users", "overrides"))
    forced = lb.build_overrides(spark.createDataFrame([("hello all", "Profanity", "feedback", 1)], "text string, label string, extra string, seq long"))
    st.append_overrides(forced, overrides, 0)
    st.stream_classify(stream, settings, out, overrides, users, once=True).awaitTermination()
    cols = ["id", "ai_input", "path", "label", "offensive_score", "bucket"]
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 4
    batch = cl.classify(
        df.filter(F.trim("text") != ""),
        cl.ClassifierSettings(settings.normaliser, settings.scorer, forced, us.first_seen(df, "room"), "room"),
    )
    assert sorted(rows(got.select(*cols))) == sorted(rows(batch.select(*cols)))


def test_stream_users_and_replay(spark, tmp_path):
    df, stream = incoming(spark, tmp_path)
    path = str(tmp_path / "users")
    st.stream_active_users(stream, path, "room", once=True).awaitTermination()
    seen = "room string, name string, first_seen long"
    assert sorted(rows(spark.read.schema(seen).parquet(f"{path}/batch=*"))) == sorted(rows(us.first_seen(df, "room")))
    st.register_users(df, path, 7, "room")  # a batch that runs twice adds nothing
    st.register_users(df, path, 7, "room")
    assert spark.read.schema(seen).parquet(f"{path}/batch=*").count() == us.first_seen(df, "room").count()


def test_first_batch_that_runs_twice_keeps_its_users(spark, tmp_path):
    df, _ = incoming(spark, tmp_path)
    path, chat = str(tmp_path / "users"), str(tmp_path / "chat")
    for _ in range(2):
        found = st.register_users(df, path, 0, "room")
        assert found.count() == us.first_seen(df, "room").count()
        st.save_user_chat(df.withColumn("label", F.lit("x")), chat, 0)
    st.save_user_chat(df.withColumn("label", F.lit("y")), chat, 1)
    assert sorted(rows(spark.read.parquet(chat).select("text"))) == sorted(rows(df.select("text").distinct()))


def test_snapshots_give_what_all_batches_give(spark, tmp_path):
    users, overrides = str(tmp_path / "users"), str(tmp_path / "overrides")
    chat = "room string, username string, seq long"
    for batch in (0, 1, 2, 2, 3, 4, 4, 5):  # some run twice, one of them with a snapshot
        sent = spark.createDataFrame([("r", f"user {batch % 4}", batch), ("r", f"user {batch}", batch)], chat)
        found = st.register_users(sent, users, batch, "room", every=2)
        assert sorted((r["name"], r["first_seen"]) for r in found.collect()) == [(f"user {i}", i) for i in range(batch + 1)]
        forced = spark.createDataFrame([("same", f"label {batch}", batch), (f"key {batch}", "x", batch)], "key string, label string, seq long")
        st.append_overrides(forced, overrides, batch, every=2)
    now = st.refresh_overrides(spark, overrides)
    assert sorted(rows(now)) == sorted([("same", "label 5", 5), *((f"key {i}", "x", i) for i in range(6))])
    for path, frame in ((users, found), (overrides, now)):
        assert st._snapshots(spark, path) == [1, 3]
        read = {name.rsplit("/", 2)[1] for name in frame.inputFiles()}
        assert "upto=3" in read and "upto=1" not in read


def test_action_state_of_batches_is_that_of_the_log(spark, tmp_path):
    schema, path = "seq long, message_id string, kind string, value string", str(tmp_path / "state")
    kinds = [("report", None), ("reveal", None), ("classify", "hate_speech"), ("classify", "not_hate_speech "), ("classify", "so"), ("reveal", None)]
    # Batches come with the later actions first; "hot" has most of them.
    log = [(1000 - k, "hot" if k % 3 else f"m{k % 11}", *kinds[k * 7 % 6]) for k in range(240)] + [(2000, None, "report", None)]
    for batch in (0, 1, 2, 1, 2, 3, 4, 4, 5):  # some run again
        st.append_actions(spark.createDataFrame(log[40 * batch : 40 * batch + 41 if batch == 5 else 40 * batch + 40], schema), path, batch, every=2)
        upto = 241 if batch == 5 else 40 * batch + 40
        if batch in (2, 5):
            now = st.refresh_action_state(spark, path, batch + 1)
            assert sorted(rows(now), key=str) == sorted(rows(ac.action_state(spark.createDataFrame(log[:upto], schema))), key=str)
    read = {name.rsplit("/", 2)[1] for name in st.refresh_action_state(spark, path).inputFiles()}
    assert "upto=3" in read and "upto=1" not in read
    st.append_actions(spark.createDataFrame([], schema), path, 6, every=2)
    assert sorted(rows(st.refresh_action_state(spark, path)), key=str) == sorted(rows(now), key=str)


def test_order_of_rows_over_files(spark, tmp_path):
    import os

    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "b.tsv").write_text("hello\tProfanity\tfeedback\n")
    os.utime(folder / "b.tsv", (1_000_000, 1_000_000))
    (folder / "a.tsv").write_text("".join(f"text {i}\tNot_offensive\tseed\n" for i in range(3000)) + "hello\tNot_offensive\tfeedback\n")
    got = rd.read_corpus(spark, str(folder))
    assert [r["text"] for r in got.orderBy("seq").collect()] == ["hello", *(f"text {i}" for i in range(3000)), "hello"]
    assert [r["label"] for r in lb.build_overrides(got).filter("key = 'hello'").collect()] == ["Not_offensive"]


def test_stream_dedupe_and_stats(spark, tmp_path):
    df, stream = incoming(spark, tmp_path)
    out = str(tmp_path / "texts")
    st.write_table(st.stream_dedupe(stream).select("text"), out, once=True).awaitTermination()
    assert sorted(rows(spark.read.parquet(out))) == sorted(rows(df.select("text").distinct()))
    flags = stream.select("room", F.col("text").contains("moron").alias("is_offensive"), F.lit(None).cast("boolean").alias("reported"), F.lit("hate_speech").alias("user_classification"))
    counts = str(tmp_path / "counts")
    st.write_table(st.stream_stats(flags, ["room"]), counts, "complete", once=True).awaitTermination()
    last = spark.read.parquet(counts).filter("batch = 3").drop("batch")
    assert {r["room"]: (r["total"], r["offensive"], r["reported"]) for r in last.collect()} == {
        "r0": (8, 0, 0), "r1": (8, 4, 0), "r2": (8, 0, 0),
    }


# -- training ---------------------------------------------------------------------------


def test_retrain_save_and_load(spark, tmp_path):
    texts = [(f"you {'moron' if i % 2 else 'dear'} number {i}", "Profanity" if i % 2 else "Not_offensive", "seed", i) for i in range(120)]
    corpus = spark.createDataFrame(texts, "text string, label string, extra string, seq long")
    settings = tr.RetrainSettings(
        {"corpus": corpus, "user_chat": None}, str(tmp_path / "splits"), str(tmp_path / "model"), features=1 << 10, max_iter=8
    )
    done = tr.retrain(spark, settings)
    # 5 % of 96 rows and the 24 held out; both are scored.
    assert (done.validation.first()["n"], done.holdout.first()["n"]) == (5, 24)
    train = rd.read_corpus(spark, str(tmp_path / "splits/train"))
    holdout = rd.read_corpus(spark, str(tmp_path / "splits/holdout"))
    assert (train.count(), holdout.count()) == (96, 24)
    assert train.join(holdout, "text").count() == 0
    scorer = so.pipeline_scorer(tr.load_model(str(tmp_path / "model")))
    test = holdout.select("text", F.when(F.col("label") == "Profanity", "Offensive").otherwise("Not_offensive").alias("truth"))
    got = cl.predict_binary(test, "text", scorer, threshold=0.5, truth="truth")
    assert got.filter("correct").count() == 24
    assert got.columns[:2] == ["text", "truth"]


def test_windowed_stats_count_late_rows_within_the_watermark(spark, tmp_path):
    schema = "ts timestamp, room string, is_offensive boolean, reported boolean, user_classification string"
    files = [
        [("2024-01-01 10:05:00", "a", True, None, None), ("2024-01-01 12:00:00", "a", False, True, "hate_speech")],
        [("2024-01-01 10:59:00", "a", True, None, None), ("2024-01-01 15:30:00", "b", None, None, None)],  # 61 minutes late
        [("2024-01-01 15:31:00", "b", None, None, None)],  # a batch drops what the watermark of the batch before it rules out
        [("2024-01-01 10:30:00", "a", True, None, None), ("2024-01-01 13:59:00", "a", None, None, None)],  # the first one is too late now
    ]
    for i, rows_ in enumerate(files):
        df = spark.createDataFrame(rows_, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        time.sleep(1.1)  # files are taken by time of change
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    counted = st.stream_stats_windowed(stream, "ts", "1 hour", "2 hours", ["room"])
    out = str(tmp_path / "out")
    st.write_table(counted, out, "update", str(tmp_path / "checkpoint"), once=True).awaitTermination()
    found = st.latest_rows(spark, out, ["window_start", "room"]).select(F.hour("window_start").alias("h"), "room", "total", "offensive", "reported")
    assert sorted(rows(found)) == [(10, "a", 2, 2, 0), (12, "a", 1, 0, 1), (13, "a", 1, 0, 0), (15, "b", 2, 0, 0)]
    first = st.latest_rows(spark, out, ["window_start", "room"], before=1)
    assert first.count() == 2


def test_rows_are_in_the_order_of_files_and_lines(spark, tmp_path):
    """Also beyond a million files: the numbers leave room, and a later file never comes first."""
    want = []
    for i in range(12):
        path = tmp_path / f"{'zyxwvutsrqpo'[i]}.tsv"
        lines = [f"{i}-{k}" for k in range(1 + i * 37 % 50)]
        path.write_text("".join(f"{x}\tlabel\tseed\n" for x in lines), encoding="utf-8")
        os.utime(path, (1_700_000_000 + i // 2, 1_700_000_000 + i // 2))
        want.append((i // 2, path.name, lines))
    got = rd.read_corpus(spark, str(tmp_path)).orderBy("seq")
    assert [r["text"] for r in got.collect()] == [x for *_, lines in sorted(want) for x in lines]
    files = 500_000_000
    assert files * rd._TASK_ROWS + (1 << 61) < 1 << 63


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    from wardline.bindings import action_queries as aq

    docs = [(1, "en", "src1", 2500), (2, "en", "src2", 10), (3, "de", "src1", 10), (4, None, None, None)]
    table = spark.createDataFrame(docs, "doc_id bigint, lang string, source string, n_chars bigint").withColumn("text", F.lit("x"))
    (tmp_path / "folder").mkdir()
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    got = aq.stream_stats(spark, str(tmp_path / "folder")).select("lang", "total", "offensive", "reported")
    assert sorted(rows(got), key=str) == [("de", 1, 0, 1), ("en", 2, 1, 1), (None, 1, 0, 0)]
    assert rows(aq.stream_dedupe(spark, str(tmp_path / "folder"))) == [("x",)]


def test_rows_are_not_shuffled_to_be_numbered(spark, tmp_path):
    (tmp_path / "f.csv").write_text("2024-01-01T10:00:00,1,hi,Profanity,0.5,Not_offensive\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rd.read_feedback(spark, str(tmp_path / "f.csv"))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
