import pytest
from pyspark.sql import functions as F

from wardline.bindings import base
from wardline.functions import scores as sc
from wardline.operators import labels as lb
from wardline.operators import messages as ms
from wardline.operators import rules as rl
from wardline.operators import users as us
from wardline.plans import classify as cl
from wardline.plans import scoring as so


def result(spark, rows, **changes):
    df = spark.createDataFrame(rows, "id string, seq long, room string, text string, username string, is_audio boolean, guard_on boolean")
    settings = cl.ClassifierSettings(
        **{"normaliser": base.normaliser_settings(spark, phonetic=False), "scorer": so.lexicon_scorer(base.TERMS), **changes}
    )
    return {r["id"]: r for r in cl.classify(df, settings).collect()}


def message(i, text, audio=False, guard=True, user="Ann", room="r"):
    return (str(i), i, room, text, user, audio, guard)


@pytest.mark.parametrize(
    "hits, raw, gated, offensive, bucket",
    [
        (0, 0.0, 0.0, False, "safe"), (1, 0.5, 0.99, True, "extreme"), (3, 0.75, 0.99, True, "extreme"), (4, 0.8, 0.8, False, "safe"),
        (5, 0.8333, 0.8333, True, "high"), (18, 0.9474, 0.9474, True, "high"), (19, 0.95, 0.95, True, "extreme"),
    ],
)
def test_scores_by_hits(spark, hits, raw, gated, offensive, bucket):
    text = " ".join(["moron"] * hits) or "calm"
    got = result(spark, [message(1, text), message(2, text, audio=True)])
    assert (got["1"]["offensive_score"], got["1"]["is_offensive"], got["1"]["bucket"]) == (gated, offensive, bucket)
    assert got["2"]["offensive_score"] == raw
    assert abs(got["2"]["offensive_score"] + got["2"]["safe_score"] - 1) < 1e-9


def test_never_mild(spark):
    scores = spark.range(0, 1001).select((F.col("id") / 1000).alias("s"))
    rows = scores.select(sc.bucket(F.col("s")).alias("b"), sc.is_offensive(F.col("s")).alias("o")).distinct().collect()
    assert {(r["b"], r["o"]) for r in rows} == {("safe", False), ("high", True), ("extreme", True)}


def test_overrides(spark):
    rows = [
        ("Hi There", "Profanity", "feedback", 1),
        ("hi there ", "Not_offensive", "user_classify", 2),
        ("hi there", "Profanity", "user_chat", 3),
        ("odd", "made-up", "feedback", 4),
        ("foreign", "Not_in_intended_language", "feedback", 5),
    ]
    overrides = lb.build_overrides(spark.createDataFrame(rows, "text string, label string, extra string, seq long"))
    got = result(spark, [message(1, " HI there"), message(2, "odd"), message(3, "foreign")], overrides=overrides)
    one = lambda r: (r["label"], r["label_display"], r["offensive_score"], r["safe_score"], r["is_offensive"], r["bucket"], r["all_scores"])
    assert one(got["1"]) == ("Not_offensive", "Safe", 0.0, 1.0, False, "safe", {"Not_offensive": 1.0})
    assert one(got["2"]) == ("made-up", "made-up", 1.0, 0.0, True, "high", {"made-up": 1.0})
    assert one(got["3"]) == ("Not_in_intended_language", "Not Malayalam", 1.0, 0.0, True, "safe", {"Not_in_intended_language": 1.0})


def test_intercept_guard_and_gate(spark):
    got = result(spark, [message(1, "hey"), message(2, "moron", guard=False), message(3, "M O R O N")])
    assert (got["1"]["path"], got["1"]["safe_score"], got["1"]["all_scores"]) == ("intercept", 1.0, {"Not_offensive": 1.0})
    off = got["2"]
    assert (off["path"], off["label"], off["label_display"], off["safe_score"], off["all_scores"]) == ("off", "Not_offensive", None, None, None)
    assert off["transliterated"] == "moron"
    assert (got["3"]["label"], got["3"]["all_scores"]) == ("Profanity", {"Profanity": 0.99, "Not_offensive": 0.01})


def test_gate_can_be_left_out(spark):
    assert result(spark, [message(1, "moron")], gate=False)["1"]["is_offensive"] is False


def test_python_model_is_asked_only_for_rows_that_need_it(spark):
    def load():
        def predict(texts):
            assert all("hey" not in t and t != "friend" for t in texts)
            return [{"Not_offensive": 0.05, "Profanity": 0.95} for _ in texts]

        return predict

    got = result(spark, [message(1, "hey"), message(2, "calm")], scorer=so.batch_scorer(load, "needs_score"))
    assert got["1"]["path"] == "intercept" and got["1"]["is_offensive"] is False
    assert got["2"]["is_offensive"] is True and got["2"]["bucket"] == "extreme"


NAMES = [
    message(1, "hello", user="Stupid Bob"),
    message(2, "stupid bob is here", user="Guest"),
    message(3, "clown said stupid bob", user="Clown"),
    message(4, "clown again", user="x", room="other"),
    message(5, "a!!b stupid  bob", user="!!"),
]


@pytest.mark.parametrize("room", ["room", None])
def test_names_seen_so_far_are_masked(spark, room):
    df = spark.createDataFrame(NAMES, "id string, seq long, room string, text string, username string, is_audio boolean, guard_on boolean")
    out = us.mask_active_users(df, us.first_seen(df, room), "text", "id", room)
    got = {r["id"]: r["text"] for r in out.collect()}
    assert got["1"] == "hello"
    assert got["2"] == "friend is here"
    assert got["3"] == "friend said friend"
    assert got["4"] == ("clown again" if room else "friend again")
    assert got["5"] == "afriendb stupid  bob"


def test_defaults_tags_and_blank_messages(spark):
    rows = [(" a ", None, None, None, None), (" \n", "c", "u", True, False)]
    df = spark.createDataFrame(rows, "text string, client_id string, username string, is_audio boolean, guard_on boolean")
    got = ms.with_defaults(ms.valid_messages(df)).collect()
    assert [tuple(r) for r in got] == [("a", "unknown", "Guest", False, True)]
    tagged = ms.tag_source(df.withColumn("username", F.lit("Z"))).collect()
    assert [r["username"] for r in tagged] == ["[Telegram] Z", "[Telegram Audio] Z"]


def test_top_label_takes_the_first_on_a_tie(spark):
    scores = sc.score_list(b=F.lit(0.5), a=F.lit(0.5))
    assert spark.range(1).select(sc.top_label(scores)).first()[0] == "b"


def test_same_answer_with_the_lexicon_as_a_table(spark):
    rows = [message(i, t) for i, t in enumerate(["megamoron da idiot", "you loseer", "calm", "hey"])]
    small = result(spark, rows)
    large = result(spark, rows, normaliser=base.normaliser_settings(spark, phonetic=False, inline_limit=0))
    assert small == large


def test_long_list_of_exception_words(spark):
    df = spark.createDataFrame([("1", "alpha beta gamma"), ("2", "alphabet w77 a-b"), ("3", None), ("4", "")], "id string, text string")
    words = ["alpha", "beta", "a-b", "alpha beta", *(f"w{i}" for i in range(10_001))]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["id"]: r["text"] for r in us.mask_listed_words(df, table, "text", "id").collect()}
    assert got == {"1": "friend gamma", "2": "alphabet friend friend", "3": None, "4": ""}
    short = ["alpha", "beta", "a-b", "alpha beta", "w77"]
    assert got == {r["id"]: r["text"] for r in rl.mask_words(df, "text", short).collect()}


def test_names_that_share_a_word_do_not_meet(spark):
    users = spark.createDataFrame([(f"user {i}", 0) for i in range(10_000)], "name string, first_seen long")
    df = spark.createDataFrame([(str(i), i, f"the user said {i}") for i in range(20)] + [("x", 99, "user 77 and user 9999!")], "id string, seq long, text string")
    found = us.names_in(df.select("id", "text"), users, "text", [])
    assert found.count() == 2
    assert {r["id"]: r["text"] for r in us.mask_active_users(df, users, "text").collect()}["x"] == "friend and friend!"


def test_only_the_text_goes_to_a_python_model(spark):
    df = spark.createDataFrame([("a", "x" * 100, True), ("b", "y", False), (None, "z", None)], "text string, other string, needs boolean")
    scored = so.batch_scorer(lambda: lambda texts: [{"Profanity": len(t) / 2} for t in texts], needed="needs")(df, "text")
    assert "MapInPandas" not in scored._jdf.queryExecution().toString() and scored.columns == [*df.columns, "scores"]
    assert [(r["other"][0], r["scores"] and r["scores"][0]["score"]) for r in scored.orderBy("other").collect()] == [("x", 0.5), ("y", None), ("z", None)]


def test_names_of_words_are_masked_in_one_pass_as_one_by_one(spark):
    rows = [("al met al-x and friend, al_x bo", ["al", "bo", "friend", "al_x"]), ("al met al-x bo", ["al", "al-x", "bo"]), ("nobody", [])]
    df = spark.createDataFrame(rows, "text string, names array<string>")
    got = [r[0] for r in df.select(us.mask_names(F.col("text"), F.col("names"))).collect()]
    assert got == ["friend met friend-x and friend, friend friend", "friend met friend friend", "nobody"]
