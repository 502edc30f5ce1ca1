"""Labels, overrides, scoring, classification, evaluation and review on the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wardline.bindings import base as b
from wardline.bindings import oracle_text as o
from wardline.bindings.base import classified, corpus, lit, load, messages, query, scored, verdicts, with_
from wardline.functions import scores as sc
from wardline.functions import text as tx
from wardline.operators import curation as cu
from wardline.operators import evaluation as ev
from wardline.operators import labels as lb
from wardline.operators import messages as ms
from wardline.operators import review as rv
from wardline.operators import users as us
from wardline.plans import classify as cl
from wardline.plans import scoring as so

SAFE = b.sql_in(lb.SAFE_LABELS)

# -- labels and overrides ------------------------------------------------------------

OVERRIDES = f"""overrides AS (SELECT {b.sql_key('text')} AS key, arg_max(label, seq) AS label, max(seq) AS seq FROM corpus
  WHERE extra IN ('user_classify', 'feedback') AND label IS NOT NULL GROUP BY 1)"""


def overrides(spark, sf):
    return lb.build_overrides(cu.drop_unlabelled(corpus(spark, sf)))


@query("overrides", with_(b.CORPUS, OVERRIDES) + "SELECT * FROM overrides")
def build_overrides(spark, sf):
    return overrides(spark, sf)


@query(
    "override_lookup",
    with_(b.CORPUS, OVERRIDES)
    + f"SELECT d.doc_id, o.label AS forced_label FROM documents d LEFT JOIN overrides o ON o.key = {b.sql_key('d.text')}",
)
def override_lookup(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", tx.norm_key(F.col("text")).alias("key"))
    return lb.apply_overrides(docs, overrides(spark, sf)).select("doc_id", "forced_label")


@query(
    "label_map",
    with_(b.CORPUS, b.LABEL_DIM) + "SELECT doc_id, label, canonical AS mapped_label FROM corpus JOIN label_dim ON raw = label",
)
def label_map(spark, sf):
    return lb.map_labels(corpus(spark, sf).select("doc_id", "label"), lb.label_dim(spark))


@query(
    "label_ids",
    with_(b.CORPUS, b.LABEL_DIM) + "SELECT doc_id, canonical AS mapped_label, label_id FROM corpus JOIN label_dim ON raw = label",
)
def label_ids(spark, sf):
    dim = lb.label_dim(spark)
    return lb.label_ids(lb.map_labels(corpus(spark, sf).select("doc_id", "label"), dim), dim).drop("label")


@query(
    "label_meta",
    with_(b.CORPUS, b.LABEL_DIM)
    + """SELECT doc_id, label, coalesce(display, label) AS label_display, coalesce(severity, 'unknown') AS severity,
  coalesce(severity, CASE WHEN label <> 'Not_offensive' THEN 'high' ELSE 'safe' END) AS forced_severity
FROM corpus LEFT JOIN label_dim ON raw = canonical AND canonical = label WHERE label IS NOT NULL""",
)
def label_meta(spark, sf):
    dim, rows = lb.label_dim(spark), cu.drop_unlabelled(corpus(spark, sf)).select("doc_id", "label")
    model = lb.label_meta(rows, dim)
    forced = lb.label_meta(model.withColumnRenamed("severity", "model_severity").drop("label_display"), dim, "override")
    return forced.select(
        "doc_id", "label", "label_display", F.col("model_severity").alias("severity"), F.col("severity").alias("forced_severity")
    )


@query("label_is_safe", with_(b.CORPUS) + f"SELECT doc_id, label IN {SAFE} AS is_safe FROM corpus")
def label_is_safe(spark, sf):
    return corpus(spark, sf).select("doc_id", lb.label_is_safe(F.col("label")).alias("is_safe"))


# -- scores ----------------------------------------------------------------------------


@query("fold_scores", with_(b.SCORED) + "SELECT doc_id, round_even(1.0 / (h + 1), 4) AS safe, round_even(offensive, 4) AS offensive FROM scored")
def fold_scores(spark, sf):
    safe = sc.safe_score(F.col("scores"), lb.SAFE_LABELS)
    return scored(spark, sf).select("doc_id", sc.rounded(safe).alias("safe"), sc.rounded(F.col("offensive")).alias("offensive"))


GATED = """gated AS (SELECT *, h > 0 AND offensive < 0.8::DOUBLE AS gated,
  CASE WHEN h > 0 AND offensive < 0.8::DOUBLE THEN 0.99::DOUBLE ELSE offensive END AS off,
  CASE WHEN h > 0 AND offensive < 0.8::DOUBLE THEN 0.01::DOUBLE ELSE 1.0::DOUBLE - offensive END AS safe FROM scored)"""


@query("gate_scores", with_(b.SCORED, GATED) + "SELECT doc_id, gated, round_even(off, 4) AS offensive, round_even(safe, 4) AS safe FROM gated")
def gate_scores(spark, sf):
    df = scored(spark, sf).withColumn("safe", 1 - F.col("offensive"))
    out = cl.apply_gate(df, F.col("h") > 0)
    return out.select("doc_id", "gated", sc.rounded(F.col("offensive")).alias("offensive"), sc.rounded(F.col("safe")).alias("safe"))


@query("top_label", with_(b.SCORED) + "SELECT doc_id, CASE WHEN h > 1 THEN 'Profanity' ELSE 'Not_offensive' END AS label FROM scored")
def top_label(spark, sf):
    return scored(spark, sf).select("doc_id", sc.top_label(F.col("scores")).alias("label"))


@query("threshold", with_(b.SCORED) + "SELECT doc_id, h, offensive > 0.8::DOUBLE AS is_offensive, offensive > 0.5::DOUBLE AS is_suspect FROM scored")
def threshold(spark, sf):
    score = F.col("offensive")
    return scored(spark, sf).select(
        "doc_id", "h", sc.is_offensive(score).alias("is_offensive"), sc.is_offensive(score, 0.5).alias("is_suspect")
    )


BUCKET = "CASE WHEN off <= 0.8::DOUBLE THEN 'safe' WHEN off < 0.8::DOUBLE THEN 'mild' WHEN off < 0.95::DOUBLE THEN 'high' ELSE 'extreme' END"


@query("severity_bucket", with_(b.SCORED, GATED) + f"SELECT doc_id, h, {BUCKET} AS bucket FROM gated")
def severity_bucket(spark, sf):
    df = cl.apply_gate(scored(spark, sf).withColumn("safe", 1 - F.col("offensive")), F.col("h") > 0)
    return df.select("doc_id", "h", sc.bucket(F.col("offensive")).alias("bucket"))


@query(
    "score_result",
    with_(b.SCORED)
    + """SELECT doc_id, unnest(['Not_offensive', 'Profanity']) AS label,
  unnest([round_even(1.0::DOUBLE / (h + 1), 4), round_even(h::DOUBLE / (h + 1), 4)]) AS score FROM scored""",
)
def score_result(spark, sf):
    """The label-to-score map of the result, one row per entry."""
    return scored(spark, sf).select("doc_id", F.explode(sc.scores_map(F.col("scores"))).alias("label", "score"))


@query(
    "override_result",
    with_(b.CORPUS, b.LABEL_DIM)
    + """SELECT doc_id, label, coalesce(display, label) AS label_display,
  CASE WHEN label <> 'Not_offensive' THEN 1.0 ELSE 0.0 END::DOUBLE AS offensive_score,
  CASE WHEN label <> 'Not_offensive' THEN 0.0 ELSE 1.0 END::DOUBLE AS safe_score, label <> 'Not_offensive' AS is_offensive,
  coalesce(severity, CASE WHEN label <> 'Not_offensive' THEN 'high' ELSE 'safe' END) AS bucket
FROM corpus LEFT JOIN label_dim ON raw = canonical AND canonical = label WHERE label IS NOT NULL""",
)
def override_result(spark, sf):
    rows = cu.drop_unlabelled(corpus(spark, sf)).select("doc_id", F.col("label").alias("forced_label"))
    return cl.override_result(rows, lb.label_dim(spark)).drop("forced_label", "all_scores")


def _word_model():
    pattern = re.compile("|".join(r"\s*".join(ch + "+" for ch in t) for t in b.TERMS))

    def predict(texts):
        counts = [len(pattern.findall(t)) for t in texts]
        return [{"Not_offensive": 1 / (n + 1), "Profanity": n / (n + 1)} for n in counts]

    return predict


@query(
    "batch_score",
    f"""SELECT doc_id, round_even(1.0::DOUBLE - 1.0::DOUBLE / (1 + len(regexp_extract_all(lower(text), {b.gate_sql()}))), 4) AS offensive
FROM documents""",
)
def batch_score(spark, sf):
    """A Python model on Arrow batches, loaded once per task."""
    docs = b.load_spread(spark, sf, "documents", "doc_id", "text").withColumn("text", F.lower("text"))
    df = so.batch_scorer(_word_model)(docs, "text")
    return df.select("doc_id", sc.rounded(sc.fold_scores(F.col("scores"), lb.SAFE_LABELS)).alias("offensive"))


# -- the classifier ----------------------------------------------------------------------


def classifier_settings(spark, sf, **changes) -> cl.ClassifierSettings:
    msgs = messages(spark, sf)
    values = dict(
        normaliser=b.normaliser_settings(spark),
        scorer=so.lexicon_scorer(b.TERMS),
        overrides=message_overrides(msgs),
        users=us.first_seen(msgs, "room"),
        room="room",
    )
    return cl.ClassifierSettings(**{**values, **changes})


def message_overrides(msgs):
    """Human labels for some of the messages, unknown labels among them."""
    h = tx.hash_int(F.concat(F.lit("forced:"), "id"))
    labels = F.array(*[F.lit(x) for x in b.RAW])
    chosen = F.element_at(labels, (F.floor(h / 16) % len(b.RAW) + 1).cast("int"))
    rows = msgs.select("text", F.when(h % 16 == 0, chosen).alias("label"), F.lit("feedback").alias("extra"), "seq")
    return lb.build_overrides(cu.drop_unlabelled(rows))


_FORCED = b.sql_hash("'forced:' || id")
CLASSIFY = with_(
    b.MESSAGES,
    b.SCORED.split(",\nscored")[0].replace("hits AS", "unused AS"),
    b.LABEL_DIM,
    f"""forced AS (SELECT {b.sql_key('text')} AS key, arg_max(({b.sql_list(b.RAW)})[{_FORCED} // 16 % {len(b.RAW)} + 1], seq) AS forced_label
  FROM messages WHERE {_FORCED} % 16 = 0 GROUP BY 1)""",
    "users AS (SELECT room, lower(username) AS name, min(seq) AS first_seen FROM messages WHERE username <> '' GROUP BY ALL)",
    o.full_normaliser("messages", "id", "norm", b),
    f"""proc AS (SELECT m.*, CASE WHEN is_audio THEN {b.sql_strip('m.text')} ELSE n.text END AS processed, forced_label
  FROM messages m JOIN norm n USING (id) LEFT JOIN forced f ON f.key = {b.sql_key('m.text')})""",
    f"masked AS (SELECT *, {o.mask('processed', b.EXCEPTIONS)} AS low FROM proc)",
    f"cut AS (SELECT id, seq, room, {o.pieces('low')} AS parts FROM masked)",
    "flat AS (SELECT id, seq, room, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS place FROM cut)",
    """inp AS (SELECT f.id, string_agg(CASE WHEN u.first_seen <= f.seq THEN 'friend' ELSE part END, '' ORDER BY place) AS ai_input
  FROM flat f LEFT JOIN users u ON u.room = f.room AND u.name = f.part AND u.name <> 'guest' GROUP BY f.id)""",
    f"""m AS (SELECT masked.*, coalesce(ai_input, '') AS ai_input, len(regexp_extract_all(coalesce(ai_input, ''), {b.gate_sql()})) AS h,
    CASE WHEN NOT guard_on THEN 'off' WHEN forced_label IS NOT NULL THEN 'override'
      WHEN {b.sql_strip('processed')} = 'friend' THEN 'intercept' ELSE 'model' END AS path
  FROM masked LEFT JOIN inp USING (id))""",
    """s AS (SELECT *, h > 0 AND NOT is_audio AND h < 4 AS gated, 1.0::DOUBLE - 1.0::DOUBLE / (h + 1) AS raw FROM m)""",
    """t AS (SELECT *, CASE WHEN gated THEN 0.99::DOUBLE ELSE raw END AS off, CASE WHEN gated THEN 0.01::DOUBLE ELSE 1.0::DOUBLE / (h + 1) END AS safe FROM s)""",
    """r AS (SELECT *, CASE path WHEN 'model' THEN CASE WHEN gated OR h > 1 THEN 'Profanity' ELSE 'Not_offensive' END
    WHEN 'override' THEN forced_label ELSE 'Not_offensive' END AS label FROM t)""",
) + f"""SELECT id, ai_input, path, r.label,
  CASE WHEN path <> 'off' THEN coalesce(display, r.label) END AS label_display,
  CASE path WHEN 'model' THEN round_even(off, 4) WHEN 'override' THEN (forced_label <> 'Not_offensive')::INT ELSE 0 END::DOUBLE AS offensive_score,
  CASE path WHEN 'model' THEN round_even(safe, 4) WHEN 'override' THEN (forced_label = 'Not_offensive')::INT WHEN 'intercept' THEN 1 END::DOUBLE AS safe_score,
  CASE path WHEN 'model' THEN off > 0.8::DOUBLE WHEN 'override' THEN forced_label <> 'Not_offensive' ELSE false END AS is_offensive,
  CASE path WHEN 'model' THEN {BUCKET} WHEN 'override' THEN coalesce(severity, CASE WHEN r.label <> 'Not_offensive' THEN 'high' ELSE 'safe' END)
    ELSE 'safe' END AS bucket
FROM r LEFT JOIN label_dim d ON d.raw = d.canonical AND d.canonical = r.label"""

RESULT = ["id", "ai_input", "path", "label", "label_display", "offensive_score", "safe_score", "is_offensive", "bucket"]


@query("classify_full", CLASSIFY)
def classify_full(spark, sf):
    return cl.classify(messages(spark, sf), classifier_settings(spark, sf)).select(*RESULT)


@query("classify_with_python_model", CLASSIFY)
def classify_with_python_model(spark, sf):
    """The same with a Python model that is asked only for rows that need a score."""
    settings = classifier_settings(spark, sf, scorer=so.batch_scorer(_word_model, needed="needs_score"))
    return cl.classify(messages(spark, sf), settings).select(*RESULT)


@query(
    "guard_off",
    with_(b.MESSAGES)
    + f"""SELECT id, c.label, label_display, offensive_score, safe_score, is_offensive, bucket, CASE WHEN NOT guard_on THEN m.text END AS transliterated
FROM ({CLASSIFY}) c JOIN messages m USING (id)""",
)
def guard_off(spark, sf):
    """The classifier on messages of which some were sent while the guard was off."""
    found = cl.classify(messages(spark, sf), classifier_settings(spark, sf))
    return found.select("id", "label", "label_display", "offensive_score", "safe_score", "is_offensive", "bucket", "transliterated")


@query(
    "predict_binary",
    with_(b.SCORED)
    + """SELECT doc_id, CASE WHEN offensive > 0.8::DOUBLE THEN 'Offensive' ELSE 'Not_offensive' END AS predicted,
  round_even(offensive, 4) AS offensive_score, (toxic = 1) = (offensive > 0.8::DOUBLE) AS correct FROM scored JOIN labels USING (doc_id)""",
)
def predict_binary(spark, sf):
    truth = load(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "Offensive").otherwise("Not_offensive").alias("true_label")
    )
    docs = b.load_spread(spark, sf, "documents", "doc_id", "text").withColumn("text", F.lower("text")).join(truth, "doc_id")
    out = cl.predict_binary(docs, "text", so.lexicon_scorer(b.TERMS), truth="true_label")
    return out.select("doc_id", "predicted", "offensive_score", "correct")


# -- evaluation -----------------------------------------------------------------------------


@query("mistakes", with_(b.VERDICTS) + "SELECT doc_id, true_label, predicted, offensive_score FROM verdicts WHERE NOT correct")
def mistakes(spark, sf):
    return ev.mistakes(verdicts(spark, sf)).select("doc_id", "true_label", "predicted", "offensive_score")


def _metrics_sql(source: str, truth: str, pred: str) -> str:
    return f"""SELECT n, tp, fp, fn, round(hits / n, 6)::DOUBLE AS accuracy, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall,
  round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM (
    SELECT count(*) AS n, count(*) FILTER ({truth} = 'Offensive' AND {pred} = 'Offensive') AS tp,
      count(*) FILTER ({truth} <> 'Offensive' AND {pred} = 'Offensive') AS fp,
      count(*) FILTER ({truth} = 'Offensive' AND {pred} <> 'Offensive') AS fn, count(*) FILTER ({truth} = {pred}) AS hits FROM {source}))"""


def _report_sql(source: str, truth: str, pred: str) -> str:
    return f"""sides AS (SELECT {truth} AS label, 1 AS support, 0 AS predicted, 0 AS tp FROM {source} UNION ALL
  SELECT {pred}, 0, 1, ({truth} = {pred})::INT FROM {source}),
per AS (SELECT label, sum(support) AS support, CASE WHEN sum(predicted) = 0 THEN 0 ELSE sum(tp) / sum(predicted) END AS p,
  CASE WHEN sum(support) = 0 THEN 0 ELSE sum(tp) / sum(support) END AS r, sum(tp) AS tp FROM sides GROUP BY label),
full_report AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM per)
SELECT label, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1, support::BIGINT AS support FROM full_report
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6)::DOUBLE, sum(support)::BIGINT FROM full_report
UNION ALL SELECT 'macro avg', round(avg(p), 6)::DOUBLE, round(avg(r), 6)::DOUBLE, round(avg(f), 6)::DOUBLE, sum(support)::BIGINT FROM full_report
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6)::DOUBLE, round(sum(r * support) / sum(support), 6)::DOUBLE,
  round(sum(f * support) / sum(support), 6)::DOUBLE, sum(support)::BIGINT FROM full_report"""


@query("binary_metrics", with_(b.VERDICTS) + _metrics_sql("verdicts", "true_label", "predicted"))
def binary_metrics(spark, sf):
    return ev.binary_metrics(verdicts(spark, sf), "true_label", "predicted", "Offensive")


@query("binary_metrics_none_predicted", with_(b.VERDICTS, "none AS (SELECT true_label, 'Not_offensive' AS predicted FROM verdicts)") + _metrics_sql("none", "true_label", "predicted"))
def binary_metrics_none_predicted(spark, sf):
    """Nothing predicted positive: precision and F1 are zero, not null."""
    df = verdicts(spark, sf).withColumn("predicted", F.lit("Not_offensive"))
    return ev.binary_metrics(df, "true_label", "predicted", "Offensive")


@query("class_report", with_(b.VERDICTS)[:-1] + ",\n" + _report_sql("verdicts", "true_label", "predicted"))
def class_report(spark, sf):
    return ev.class_report(verdicts(spark, sf), "true_label", "predicted")


@query(
    "confusion_matrix",
    with_(b.VERDICTS)
    + """SELECT l.label AS truth, count(*) FILTER (predicted = 'Not_offensive') AS "Not_offensive",
  count(*) FILTER (predicted = 'Offensive') AS "Offensive"
FROM (VALUES ('Not_offensive'), ('Offensive'), ('Unused')) l(label) LEFT JOIN verdicts v ON v.true_label = l.label
GROUP BY l.label""",
)
def confusion_matrix(spark, sf):
    out = ev.confusion_matrix(verdicts(spark, sf), "true_label", "predicted", ["Not_offensive", "Offensive", "Unused"])
    return out.drop("Unused")


@query(
    "score_histogram",
    with_(
        b.VERDICTS,
        "rng AS (SELECT correct, min(offensive_score) AS lo0, max(offensive_score) AS hi0 FROM verdicts GROUP BY correct)",
        "r AS (SELECT correct, CASE WHEN hi0 = lo0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN hi0 = lo0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rng)",
        """c AS (SELECT correct, least(floor((offensive_score - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n
  FROM verdicts JOIN r USING (correct) GROUP BY ALL)""",
        "g AS (SELECT correct, lo, hi, unnest(range(20))::INTEGER AS bin FROM r)",
    )
    + """SELECT correct, bin, round(lo + (hi - lo) / 20 * bin, 6) AS bin_from, round(lo + (hi - lo) / 20 * (bin + 1), 6) AS bin_to,
  coalesce(n, 0) AS n FROM g LEFT JOIN c USING (correct, bin)""",
)
def score_histogram(spark, sf):
    return ev.score_histogram(verdicts(spark, sf), "offensive_score", "correct")


@query(
    "moderation_stats",
    with_(
        b.CLASSIFIED,
        b.ACTIONS,
        """state AS (SELECT message_id, bool_or(kind = 'report') AS reported,
    arg_max(lower(trim(value)), seq) FILTER (kind = 'classify' AND lower(trim(value)) IN ('hate_speech', 'not_hate_speech')) AS cls
  FROM actions GROUP BY 1)""",
    )
    + """SELECT lang, count(*) AS total, count(*) FILTER (is_offensive) AS offensive, count(*) FILTER (NOT is_offensive) AS safe,
  count(*) FILTER (coalesce(reported, false)) AS reported, count(*) FILTER (cls = 'hate_speech') AS classified_hate,
  count(*) FILTER (cls = 'not_hate_speech') AS classified_not_hate
FROM classified LEFT JOIN state ON id = message_id GROUP BY lang""",
)
def moderation_stats(spark, sf):
    from wardline.operators import actions as ac

    state = ac.message_state(classified(spark, sf), b.actions(spark, sf))
    return ev.moderation_stats(state, ["lang"])


# -- review ------------------------------------------------------------------------------------

# Items: documents in order with the model's label; verified: texts of those with a truth label.
REVIEW = b.CLASSIFIED + f""",
items AS (SELECT doc_id AS seq, text, CASE WHEN h > 1 THEN 'Profanity' ELSE 'Not_offensive' END AS ai_label FROM scored),
verified AS (SELECT text, CASE WHEN max(toxic) = 1 THEN 'Profanity' ELSE 'Not_offensive' END AS label FROM labels JOIN documents USING (doc_id) GROUP BY text)"""


def review_tables(spark, sf):
    items = scored(spark, sf).select(F.col("doc_id").alias("seq"), "text", sc.top_label(F.col("scores")).alias("ai_label"))
    truth = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    verified = truth.groupBy("text").agg(F.when(F.max("toxic") == 1, "Profanity").otherwise("Not_offensive").alias("label"))
    return items, verified


@query("pending_review", with_(REVIEW) + "SELECT seq, ai_label, text FROM items WHERE text NOT IN (SELECT text FROM verified)")
def pending_review(spark, sf):
    return rv.pending_review(*review_tables(spark, sf))


@query(
    "next_item",
    with_(REVIEW)
    + f"""SELECT seq, text, ai_label, ai_label IN {SAFE} AS looks_safe FROM items WHERE text NOT IN (SELECT text FROM verified)
  AND seq NOT IN (SELECT doc_id FROM documents WHERE source = 'src1') ORDER BY seq LIMIT 10""",
)
def next_item(spark, sf):
    items, verified = review_tables(spark, sf)
    skipped = load(spark, sf, "documents").filter(F.col("source") == "src1").select(F.col("doc_id").alias("seq"))
    return rv.next_item(items, verified, skipped, n=10)


@query(
    "review_progress",
    with_(REVIEW)
    + """SELECT total, done, "left", floor(done / total * 100 + 0.5)::BIGINT AS pct FROM (SELECT (SELECT count(*) FROM items) AS total,
  (SELECT count(*) FROM verified) AS done, (SELECT count(*) FROM items WHERE text NOT IN (SELECT text FROM verified)) AS "left")""",
)
def review_progress(spark, sf):
    return rv.review_progress(*review_tables(spark, sf))


PAIRED = REVIEW + f""",
paired AS (SELECT seq, i.text, ai_label, label AS human_label, CASE WHEN label IN {SAFE} THEN 'Not_offensive' ELSE 'Offensive' END AS human,
  CASE WHEN ai_label IN {SAFE} THEN 'Not_offensive' ELSE 'Offensive' END AS model FROM items i JOIN verified v ON v.text = i.text)"""


@query("human_vs_model", with_(PAIRED) + "SELECT * FROM paired")
def human_vs_model(spark, sf):
    return rv.human_vs_model(*review_tables(spark, sf))


@query(
    "review_metrics",
    with_(PAIRED)
    + f"""SELECT n AS verified_count, round(accuracy * 100, 2) AS accuracy, round(precision * 100, 2) AS precision,
  round(recall * 100, 2) AS recall, round(f1 * 100, 2) AS f1 FROM ({_metrics_sql('paired', 'human', 'model')})""",
)
def review_metrics(spark, sf):
    return rv.review_metrics(*review_tables(spark, sf))


@query("review_report", with_(PAIRED)[:-1] + ",\n" + _report_sql("paired", "human", "model"))
def review_report(spark, sf):
    return rv.review_report(*review_tables(spark, sf))
