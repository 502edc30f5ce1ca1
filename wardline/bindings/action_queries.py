"""Feedback, message state, files and streams on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.bindings import base as b
from wardline.bindings import oracle_text as o
from wardline.bindings.base import actions, classified, corpus, lit, load, messages, query, with_
from wardline.bindings.curation_queries import CURATED, _split_sql, curated, generated, GENERATED
from wardline.bindings.label_queries import CLASSIFY, RESULT, classifier_settings, message_overrides
from wardline.operators import actions as ac
from wardline.operators import curation as cu
from wardline.operators import labels as lb
from wardline.operators import messages as ms
from wardline.operators import splits as sp
from wardline.operators import users as us
from wardline.session import scratch_dir
from wardline.sources import history as hs
from wardline.sources import readers as rd
from wardline.sources import sinks as sk
from wardline.streaming import rooms as ro
from wardline.streaming import streams as st

BASE = b.CLASSIFIED + ",\n" + b.ACTIONS
VALID = "(kind <> 'classify' OR lower(trim(coalesce(value, ''))) IN ('hate_speech', 'not_hate_speech'))"

# -- actions -------------------------------------------------------------------------------


@query(
    "valid_feedback",
    with_(BASE) + f"SELECT message_id, seq, ts::TIMESTAMP AS ts, kind, value FROM actions WHERE {VALID} AND message_id IN (SELECT id FROM classified)",
)
def valid_feedback(spark, sf):
    return _plain_ts(ac.valid_feedback(actions(spark, sf), classified(spark, sf)))


def _plain_ts(df):
    """Instants without zone, as the tables have them."""
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "rejected_feedback",
    with_(BASE)
    + f"""SELECT * FROM (SELECT message_id, seq, ts::TIMESTAMP AS ts, kind, value,
  CASE WHEN message_id NOT IN (SELECT id FROM classified) THEN 'message not found' WHEN NOT {VALID} THEN 'bad classification' END AS reason
FROM actions) WHERE reason IS NOT NULL""",
)
def rejected_feedback(spark, sf):
    return _plain_ts(ac.rejected_feedback(actions(spark, sf), classified(spark, sf)))


LABELLED = f"""labelled AS (SELECT a.*, c.text, c.offensive_score, c.label AS model_label,
  CASE kind WHEN 'report' THEN coalesce(value, 'Offensive_Untargetede')
    ELSE CASE WHEN lower(trim(value)) = 'hate_speech' THEN 'Offensive_Untargetede' ELSE 'Not_offensive' END END AS label
  FROM actions a JOIN classified c ON c.id = message_id WHERE kind <> 'reveal' AND {VALID})"""


@query("report_feedback", with_(BASE, LABELLED) + "SELECT text, label, 'feedback' AS extra, seq FROM labelled WHERE kind = 'report'")
def report_feedback(spark, sf):
    return ac.report(actions(spark, sf), classified(spark, sf))


@query("user_classify", with_(BASE, LABELLED) + "SELECT text, label, 'user_classify' AS extra, seq FROM labelled WHERE kind = 'classify'")
def user_classify(spark, sf):
    return ac.user_classify(actions(spark, sf), classified(spark, sf))


@query("override_rows", with_(BASE, LABELLED) + f"SELECT {b.sql_key('text')} AS key, label, seq FROM labelled")
def override_rows(spark, sf):
    log, msgs = actions(spark, sf), classified(spark, sf)
    return ac.override_rows(ac.report(log, msgs).unionByName(ac.user_classify(log, msgs)))


@query(
    "audit_rows",
    with_(BASE, LABELLED)
    + """SELECT ts::TIMESTAMP AS ts, message_id AS id, text, label, offensive_score, model_label,
  CASE WHEN kind = 'classify' THEN 'user_classify:' || lower(trim(value)) END AS action, seq FROM labelled""",
)
def audit_rows(spark, sf):
    return _plain_ts(ac.audit_rows(actions(spark, sf), classified(spark, sf)))


# Documents are classified on the first day; two thirds again later, some twice at that instant.
AGAIN = """versions AS (
  SELECT id, TIMESTAMP '2024-01-01 06:00:00' AS ts, 1::BIGINT AS seq, label, offensive_score FROM classified
  UNION ALL SELECT id, TIMESTAMP '2024-01-01' + to_days((id::BIGINT % 25)::INTEGER), 2::BIGINT, 'Profanity',
    round_even(offensive_score / 2 + 0.5::DOUBLE, 4) FROM classified WHERE id::BIGINT % 3 <> 0
  UNION ALL SELECT id, TIMESTAMP '2024-01-01' + to_days((id::BIGINT % 25)::INTEGER), 3::BIGINT, 'Not_offensive',
    round_even(offensive_score / 2, 4) FROM classified WHERE id::BIGINT % 6 = 1),
standing AS (SELECT id, ts, arg_max(label, seq) AS model_label, arg_max(offensive_score, seq) AS offensive_score FROM versions GROUP BY id, ts)"""


def versions(spark, sf):
    """A classification log of the documents ``(id, ts, seq, label, offensive_score)``."""
    first = classified(spark, sf).select("id", "label", "offensive_score")
    number = F.col("id").cast("bigint")
    day = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (number % 25) * 86400)
    half = lambda more: F.bround(F.col("offensive_score") / 2 + more, 4)
    row = lambda ts, seq, label, score: F.struct(ts.alias("ts"), F.lit(seq).cast("long").alias("seq"), label.alias("label"), score.alias("offensive_score"))
    rows = F.array(
        row(F.lit("2024-01-01 06:00:00").cast("timestamp"), 1, F.col("label"), F.col("offensive_score")),
        F.when(number % 3 != 0, row(day, 2, F.lit("Profanity"), half(0.5))),
        F.when(number % 6 == 1, row(day, 3, F.lit("Not_offensive"), half(0.0))),
    )
    return first.select("id", F.explode(F.array_compact(rows)).alias("v")).select("id", "v.*")


@query(
    "audit_as_of",
    with_(BASE, AGAIN)
    + f"""SELECT a.ts::TIMESTAMP AS ts, message_id AS id, c.text,
  CASE kind WHEN 'report' THEN coalesce(value, 'Offensive_Untargetede')
    ELSE CASE WHEN lower(trim(value)) = 'hate_speech' THEN 'Offensive_Untargetede' ELSE 'Not_offensive' END END AS label,
  s.offensive_score, s.model_label, CASE WHEN kind = 'classify' THEN 'user_classify:' || lower(trim(value)) END AS action, a.seq
FROM actions a JOIN classified c ON c.id = message_id ASOF LEFT JOIN standing s ON s.id = a.message_id AND a.ts >= s.ts
WHERE kind <> 'reveal' AND {VALID}""",
)
def audit_as_of(spark, sf):
    """The prediction at the time of feedback, of documents that were classified more than once."""
    return _plain_ts(ac.audit_as_of(actions(spark, sf), classified(spark, sf), versions(spark, sf)))


@query("reveal_state", with_(b.ACTIONS) + "SELECT message_id, count(*) % 2 = 1 AS revealed FROM actions WHERE kind = 'reveal' GROUP BY 1")
def reveal_state(spark, sf):
    return ac.reveal_state(actions(spark, sf))


STATE = f"""state AS (SELECT message_id, bool_or(kind = 'report') AS reported, count(*) FILTER (kind = 'reveal') % 2 = 1 AS revealed,
  arg_max(lower(trim(value)), seq) FILTER (kind = 'classify' AND {VALID}) AS user_classification FROM actions GROUP BY 1)"""


MESSAGE_STATE = (
    with_(BASE, STATE)
    + """SELECT id, label, is_offensive, coalesce(reported, false) AS reported, coalesce(revealed, false) AS revealed, user_classification
FROM classified LEFT JOIN state ON message_id = id"""
)


@query("message_state", MESSAGE_STATE)
def message_state(spark, sf):
    return ac.message_state(classified(spark, sf).select("id", "label", "is_offensive"), actions(spark, sf))


NAME = "'<b>\"' || lang || '\" & ''co''</b>'"
_ESCAPED = f"""replace(replace(replace(replace(replace({NAME}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(
    "censor",
    with_(b.CLASSIFIED)
    + f"""SELECT id, CASE WHEN is_offensive THEN repeat('█', length(text)) ELSE text END AS shown,
  CASE WHEN is_offensive THEN '⚠️ <b>' || {_ESCAPED} || '</b> sent an offensive ' || CASE WHEN lang = 'en' THEN 'voice note' ELSE 'message' END
    || ':' || chr(10) || repeat('█', length(text)) END AS notice FROM classified""",
)
def censor(spark, sf):
    df = classified(spark, sf).withColumns(
        {"username": F.concat(F.lit('<b>"'), "lang", F.lit("\" & 'co'</b>")), "is_audio": F.col("lang") == "en"}
    )
    return ms.censor(df).select("id", "shown", "notice")


@query(
    "transcripts",
    with_("j AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
    + f"""SELECT conv_id::VARCHAR AS clip_id, CASE WHEN length({b.sql_strip('t')}) > 15 AND len(list_distinct(string_split({b.sql_strip('t')}, ''))) < 8
  THEN '' ELSE {b.sql_strip('t')} END AS text FROM j""",
)
def transcripts(spark, sf):
    turns = load(spark, sf, "conversations")
    return ms.assemble_transcripts(
        turns.select(F.col("conv_id").cast("string").alias("clip_id"), F.col("turn").cast("int").alias("seg_no"), "text")
    )


@query(
    "source_tags",
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '[Telegram Audio] ' ELSE '[Telegram] ' END || CASE WHEN role = 'system' THEN 'Guest' ELSE role END AS username FROM conversations",
)
def source_tags(spark, sf):
    turns = load(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("username"), (F.col("turn") % 2 == 1).alias("is_audio")
    )
    return ms.tag_source(turns).drop("is_audio")


# -- files: the given tables written out in the engine's formats and read back ----------------

TSV = dict(sep="\t", quote='"', escape='"', emptyValue="")


@query("read_corpus", with_(b.CORPUS) + "SELECT text, label, CASE WHEN doc_id % 4 <> 2 THEN extra END AS extra FROM corpus WHERE doc_id % 4 <> 3")
def read_corpus(spark, sf):
    """Rows with two, three and four fields: short ones are padded, long ones dropped."""
    path = scratch_dir(spark, "corpus")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    full = F.concat_ws("\t", quoted(F.col("text")), plain("label"), plain("extra"))
    kind = F.col("doc_id") % 4
    line = (
        F.when(kind == 2, F.concat_ws("\t", quoted(F.col("text")), plain("label")))
        .when(kind == 3, F.concat_ws("\t", full, F.lit("one too many")))
        .otherwise(full)
    )
    corpus(spark, sf).select(line.alias("value")).write.text(path)
    return rd.read_corpus(spark, path).select("text", "label", "extra")


@query("read_feedback", with_(BASE, LABELLED) + "SELECT text, label, 'user_feedback' AS extra FROM labelled")
def read_feedback(spark, sf):
    """The audit log as a comma-separated file; rows have six or seven fields."""
    path = scratch_dir(spark, "feedback")
    rows = ac.audit_rows(actions(spark, sf), classified(spark, sf))
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    score = F.coalesce(F.col("offensive_score").cast("string"), F.lit(""))
    line = F.concat_ws(",", F.col("ts").cast("string"), "id", quoted, "label", score, "model_label", "action")
    rows.select(line.alias("value")).write.text(path)
    return rd.read_feedback(spark, path).select("text", "label", "extra")


def _write_history(rows, path):
    """One JSON array per room, a file each in one folder: a folder a room would be made and listed apart."""
    rows = rows.select("room", "seq", F.struct("id", "text", "username", "is_audio").alias("m"))
    arrays = rows.groupBy("room").agg(F.array_sort(F.collect_list(F.struct("seq", "m"))).alias("ms"))
    whole = F.to_json(F.transform("ms", lambda x: x["m"]))
    arrays.select(whole.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


@query("read_messages", with_(b.MESSAGES) + "SELECT id, text, username, is_audio FROM messages")
def read_messages(spark, sf):
    """History files: one JSON array per room."""
    path = scratch_dir(spark, "history")
    _write_history(messages(spark, sf), path)
    return rd.read_messages(spark, path).select("id", "text", "username", "is_audio")


@query(
    "read_verified",
    "SELECT text, CASE WHEN max(toxic) = 1 THEN 'Profanity' ELSE 'Not_offensive' END AS label FROM labels JOIN documents USING (doc_id) GROUP BY text",
)
def read_verified(spark, sf):
    """Verified labels: one JSON object per source."""
    path = scratch_dir(spark, "verified")
    docs = load(spark, sf, "documents").select("doc_id", "text", "source")
    truth = load(spark, sf, "labels").join(docs, "doc_id").groupBy("text").agg(
        F.when(F.max("toxic") == 1, "Profanity").otherwise("Not_offensive").alias("label"), F.min("source").alias("source")
    )
    # A line for each pair: an object is written in one file, but is never one row.
    own = Window.partitionBy("source").orderBy(F.xxhash64("text"))
    lines = truth.select("source", F.to_json(F.create_map("text", "label")).alias("pair"), F.row_number().over(own).alias("place"), F.lead("label").over(own).isNull().alias("last"))
    value = F.concat(F.when(F.col("place") == 1, "{").otherwise(","), F.col("pair").substr(F.lit(2), F.length("pair") - 2), F.when(F.col("last"), "}").otherwise(""))
    objects = lines.sortWithinPartitions("source", "place").select("source", value.alias("value"))
    objects.write.partitionBy("source").text(path)
    return rd.read_verified(spark, f"{path}/source=*").select("text", "label")


@query("append_labels", with_(BASE, LABELLED) + "SELECT text, label, CASE kind WHEN 'report' THEN 'feedback' ELSE 'user_classify' END AS extra, seq FROM labelled")
def append_labels(spark, sf):
    path = scratch_dir(spark, "labels")
    sk.append_labels(ac.report(actions(spark, sf), classified(spark, sf)), path)
    sk.append_labels(ac.user_classify(actions(spark, sf), classified(spark, sf)), path)
    return spark.read.parquet(path)


@query(
    "append_user_chat",
    f"""SELECT text, arg_min(lang, doc_id) AS label, 'user_chat' AS extra, min(doc_id) AS seq FROM documents GROUP BY text""",
)
def append_user_chat(spark, sf):
    """Two appends; the second has texts that are there already."""
    path = scratch_dir(spark, "chat")
    docs = load(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"), F.col("doc_id").alias("seq"))
    half = docs.agg(F.floor(F.avg("doc_id"))).scalar()
    sk.append_user_chat(docs.filter(F.col("doc_id") <= half), path)
    sk.append_user_chat(docs.filter(F.col("doc_id") > half), path)
    return spark.read.parquet(path)


@query(
    "append_audit",
    with_(BASE, LABELLED)
    + """SELECT message_id AS id, label, CASE WHEN kind = 'classify' THEN 'user_classify:' || lower(trim(value)) END AS action,
  strftime(ts, '%Y-%m-%d') AS day FROM labelled""",
)
def append_audit(spark, sf):
    path = scratch_dir(spark, "audit")
    sk.append_audit(ac.audit_rows(actions(spark, sf), classified(spark, sf)), path)
    return spark.read.parquet(path).select("id", "label", "action", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("write_messages", with_(b.CLASSIFIED) + "SELECT id, label, offensive_score, is_offensive FROM classified")
def write_messages(spark, sf):
    path = scratch_dir(spark, "messages")
    sk.write_messages(classified(spark, sf).select("id", "label", "offensive_score", "is_offensive"), path)
    return spark.read.parquet(path)


@query(
    "write_splits",
    with_(b.CORPUS, CURATED, _split_sql("curated", "mapped_label", "0.2"))
    + """SELECT text, CASE WHEN is_holdout THEN mapped_label ELSE label END AS label, CASE WHEN NOT is_holdout THEN extra END AS extra,
  CASE WHEN is_holdout THEN 'holdout' ELSE 'train' END AS part FROM assigned""",
)
def write_splits(spark, sf):
    path = scratch_dir(spark, "splits")
    sk.write_splits(*sp.stratified_split(curated(spark, sf), "text", "mapped_label"), path)
    parts = [rd.read_corpus(spark, f"{path}/{p}", p).select("text", "label", "extra", F.col("source").alias("part")) for p in ("train", "holdout")]
    return parts[0].unionByName(parts[1])


@query("write_generated", with_(GENERATED) + "SELECT text, true_label FROM generated")
def write_generated(spark, sf):
    path = scratch_dir(spark, "generated")
    sk.write_generated(generated(spark, sf), path)
    return rd.read_generated(spark, path)


# -- streams: the tables as they land in a folder ------------------------------------------------


def table_stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of them; a stream opens a single file by pattern only."""
    schema = load(spark, sf, name).schema
    return st.stream_messages(spark, f"{sf}/{name}[.]parquet", schema)


def _finished(q):
    q.awaitTermination()
    return q


@query("stream_history", with_(b.MESSAGES) + "SELECT id, text, username, is_audio FROM messages")
def stream_history(spark, sf):
    """Histories that are rewritten whole while a stream reads them: each message once."""
    path, out, state = (scratch_dir(spark, n) for n in ("history", "messages", "state"))
    sent = messages(spark, sf)
    for rows in (sent.filter(F.col("seq") % 3 != 0), sent):
        _write_history(rows, path)
        entries = hs.stream_history(spark, path, per_file=False, suffix=".txt")
        _finished(st.write_table(entries.select("id", "text", "username", "is_audio"), out, checkpoint=state, once=True))
    return spark.read.schema("id string, text string, username string, is_audio boolean").parquet(out)


@query("stream_dedupe", "SELECT DISTINCT text FROM documents")
def stream_dedupe(spark, sf):
    out = scratch_dir(spark, "dedupe")
    texts = st.stream_dedupe(table_stream(spark, sf, "documents").select("text"))
    _finished(st.write_table(texts, out, once=True))
    return spark.read.schema("text string").parquet(out)


@query("stream_dedupe_within_watermark", "SELECT DISTINCT event_type, user_id FROM events")
def stream_dedupe_within_watermark(spark, sf):
    """State bounded by time; the horizon spans the table, so the result is exact."""
    out = scratch_dir(spark, "dedupe")
    events = table_stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", "event_type", "user_id").alias("text"), "event_type", "user_id"
    )
    _finished(st.write_table(st.stream_dedupe(events, watermark="60 days").drop("ts", "text"), out, once=True))
    return spark.read.schema("event_type string, user_id bigint").parquet(out)


@query(
    "stream_stats",
    """SELECT lang, count(*) AS total, count(*) FILTER (n_chars > 2000) AS offensive, count(*) FILTER (n_chars <= 2000) AS safe,
  count(*) FILTER (source = 'src1') AS reported, count(*) FILTER (doc_id % 3 = 0) AS classified_hate,
  count(*) FILTER (doc_id % 3 = 1) AS classified_not_hate FROM documents GROUP BY lang""",
)
def stream_stats(spark, sf):
    """Live counters over flags derived from the documents."""
    out = scratch_dir(spark, "stats")
    part = F.col("doc_id") % 3
    flags = table_stream(spark, sf, "documents").select(
        "lang",
        (F.col("n_chars") > 2000).alias("is_offensive"),
        F.when(F.col("source") == "src1", True).alias("reported"),
        F.when(part == 0, "hate_speech").when(part == 1, "not_hate_speech").alias("user_classification"),
    )
    _finished(st.write_table(st.stream_stats(flags, ["lang"]), out, mode="complete", once=True))
    # the last update holds the whole table
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch")).scalar()
    return rows.filter(F.col("batch") == last).drop("batch")


@query(
    "stream_stats_windowed",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS total, count(*) FILTER (value > 50) AS offensive,
  count(*) - count(*) FILTER (value > 50) AS safe, count(*) FILTER (event_type = 'error') AS reported,
  count(*) FILTER (event_type = 'signup') AS classified_hate, count(*) FILTER (event_type = 'purchase') AS classified_not_hate
FROM events GROUP BY ALL""",
)
def stream_stats_windowed(spark, sf):
    """Counters per day of event time, the watermark two days behind."""
    out = scratch_dir(spark, "windows")
    kind = F.col("event_type")
    flags = table_stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        (F.col("value") > 50).alias("is_offensive"),
        F.when(kind == "error", True).alias("reported"),
        F.when(kind == "signup", "hate_speech").when(kind == "purchase", "not_hate_speech").alias("user_classification"),
    )
    counted = st.stream_stats_windowed(flags, "ts", "1 day", "2 days", ["event_type"])
    _finished(st.write_table(counted, out, mode="update", once=True))
    found = st.latest_rows(spark, out, ["window_start", "event_type"]).drop("window_end")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


OVERRIDES = with_(b.CORPUS) + f"""SELECT {b.sql_key('text')} AS key, arg_max(label, seq) AS label, max(seq) AS seq FROM corpus
WHERE extra IN ('user_classify', 'feedback') AND label IS NOT NULL GROUP BY 1"""


@query("stream_overrides", OVERRIDES)
def stream_overrides(spark, sf):
    rows, out = scratch_dir(spark, "labelled"), scratch_dir(spark, "overrides")
    cu.drop_unlabelled(corpus(spark, sf)).select("text", "label", "extra", "seq").write.parquet(rows)
    stream = st.stream_messages(spark, rows, T.StructType.fromDDL("text string, label string, extra string, seq bigint"))
    _finished(st.stream_overrides(stream, out, once=True))
    return st.refresh_overrides(spark, out)


@query("stream_message_state", MESSAGE_STATE)
def stream_message_state(spark, sf):
    """The same state, kept by a stream that gets the log in several micro-batches."""
    rows, out = scratch_dir(spark, "actions"), scratch_dir(spark, "state")
    log = actions(spark, sf)
    log.repartition(4).write.parquet(rows)
    stream = st.stream_messages(spark, rows, log.schema, maxFilesPerTrigger="1")
    _finished(st.stream_action_state(stream, out, once=True, every=2))
    return ac.attach_actions(classified(spark, sf).select("id", "label", "is_offensive"), st.refresh_action_state(spark, out))


def message_stream(spark, sf):
    rows = scratch_dir(spark, "incoming")
    msgs = messages(spark, sf).withColumn("client_id", F.lit(None).cast("string"))
    msgs.write.parquet(rows)
    return st.stream_messages(spark, rows, msgs.schema)


@query(
    "stream_active_users",
    with_(b.MESSAGES)
    + "SELECT room, lower(username) AS name, min(seq) AS first_seen FROM messages WHERE username <> '' AND lower(username) <> 'guest' GROUP BY ALL",
)
def stream_active_users(spark, sf):
    out = scratch_dir(spark, "users")
    _finished(st.stream_active_users(message_stream(spark, sf), out, "room", once=True))
    return spark.read.schema("room string, name string, first_seen bigint").parquet(f"{out}/batch=*")


@query(
    "stream_room_users",
    with_(b.MESSAGES)
    + "SELECT room, lower(username) AS name, min(seq) AS first_seen FROM messages WHERE username <> '' AND lower(username) <> 'guest' GROUP BY ALL",
)
def stream_room_users(spark, sf):
    """The same table as ``stream_active_users`` from keyed state."""
    out = scratch_dir(spark, "users")
    users = ro.stream_room_users(message_stream(spark, sf), ts=None)
    _finished(st.write_table(users, out, "update", once=True))
    return st.latest_rows(spark, out, ["room", "name"]).select("room", "name", "first_seen")


@query("stream_classify", CLASSIFY)
def stream_classify(spark, sf):
    """The same rows as the batch classifier, with overrides and users kept by the stream."""
    out, overrides, users = (scratch_dir(spark, n) for n in ("classified", "overrides", "users"))
    st.append_overrides(message_overrides(messages(spark, sf)), overrides, 0)
    settings = classifier_settings(spark, sf, overrides=None, users=None)
    _finished(st.stream_classify(message_stream(spark, sf), settings, out, overrides, users, once=True))
    return spark.read.parquet(f"{out}/batch=*").select(*RESULT)


@query(
    "stream_user_chat",
    with_(b.MESSAGES)
    + f"""SELECT m.text, arg_min(c.label, m.seq) AS label, 'user_chat' AS extra, min(m.seq) AS seq
FROM ({CLASSIFY}) c JOIN messages m USING (id) GROUP BY m.text""",
)
def stream_user_chat(spark, sf):
    """Each text that the stream saw, once, with the label of its first message."""
    out, overrides, users, chat = (scratch_dir(spark, n) for n in ("classified", "overrides", "users", "chat"))
    st.append_overrides(message_overrides(messages(spark, sf)), overrides, 0)
    settings = classifier_settings(spark, sf, overrides=None, users=None)
    _finished(st.stream_classify(message_stream(spark, sf), settings, out, overrides, users, once=True, chat=chat))
    return spark.read.parquet(f"{chat}/batch=*").select("text", "label", "extra", "seq")
