"""Test configuration, derived input tables and the query registry.

Every derived table exists twice: as a DataFrame over the given tables and as
the SQL text that says the same.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import scores as sc
from wardline.functions import text as tx
from wardline.operators import lexicon as lx
from wardline.operators import rules as rl
from wardline.plans import normalise as nm
from wardline.session import small_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# -- configuration ---------------------------------------------------------------

TERMS = ["trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting"]
EXCEPTIONS = ["clowning", "trashcan", "losers", "the"]
SUFFIXES = ["ed", "ing", "ness", "ish", "ers", "y"]
PREFIXES = ["mega", "super", "uber", "da", "me"]
DROPPED = ["da", "you", "the", "your"]
RULES = [
    rl.Rule(2, 1, r"\bbruv\b", "brother"),
    rl.Rule(2, 2, r"\bbro+\b", "brother"),
    rl.Rule(2, 3, r"\bthatin\b", "that"),
    rl.Rule(2, 4, r"\byah\b", "hey"),
    rl.Rule(3, 1, r"\bhey+\b", "friend"),
    rl.Rule(3, 2, r"\bsich\b", "friend"),
]
PHRASE = rl.Rule(10, 1, r"\bgreen\s+(?:and\s+)?(?:door|gate)(?:s)?\b", "entrance")
LATE_RULES = [
    rl.Rule(12, 1, r"\bhrs\b", "hours"),
    rl.Rule(13, 1, r"\bhehely\b", "gladly"),
    rl.Rule(13, 2, r"\bononst\b", "almost"),
    rl.Rule(14, 1, r"\bdimwits?\b", "idiot"),
    rl.Rule(16, 1, r"\bfriends?\b", "friend"),
    rl.Rule(16, 2, r"\b(?:they|them|their)\b", "friend"),
    rl.Rule(16, 3, r"\bder\b", "friend"),
    rl.Rule(17, 1, r"\bdear(?:est)?\b", "friend"),
]
FORMS = ["dog", "dogs"] + TERMS[:4]
CONTEXT = ["of", "and", "the", "are", "in", "for"]
ARTICLES = ["a", "an", "the", "la"]
LINK, VERBS, TAIL = "like", ["is", "was", "of"], "insult"

STEPS = [
    nm.Rewrite(RULES),
    nm.Context(FORMS, CONTEXT, "dog"),
    nm.Article(ARTICLES, FORMS, "dog"),
    nm.StripPrefixes(PREFIXES),
    nm.Rewrite([PHRASE]),
    nm.Compare(LINK, VERBS, TAIL),
    nm.Rewrite(LATE_RULES[:4]),
    nm.DropBeforeTerm(DROPPED),
    nm.Rewrite(LATE_RULES[4:]),
]

# What people write to get round a filter, and what they write innocently.
PHRASES = [
    "what a megamoron, bro",
    "you idiottt",
    "superclownish talk",
    "bruv they are here",
    "da loseer",
    "yah dear",
    "hey friends",
    "s t u p i d",
    "stupidly so",
    "pathetik thing",
    "clowning around",
    "a trash can",
    "the dog of war",
    "nee trash",
    "he is stupid like is",
    "né like of trash",
    "green and doors",
    "you worthles moron",
    "disgustiiiing",
    "the scumness",
    "trashing it",
    "dimwits in the lab",
    "uberidiot da idiot",
    "mooooron",
]

DOCUMENTS, CONVERSATIONS = "documents", "conversations"


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [{"term": t, "pos": i} for i, t in enumerate(TERMS)]
    return small_table(spark, rows, pa.schema([("term", pa.string()), ("pos", pa.int32())]))


def exceptions(spark: SparkSession) -> DataFrame:
    return small_table(spark, [{"word": w} for w in EXCEPTIONS], pa.schema([("word", pa.string())]))


def normaliser_settings(spark: SparkSession, **changes) -> nm.Settings:
    return nm.Settings(lexicon(spark), exceptions(spark), STEPS, SUFFIXES, **changes)


# -- tables ------------------------------------------------------------------------


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load_spread(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    return spread(load(spark, sf, name).select(*cols))


def phrase_of(key: Column) -> Column:
    return tx.pick(PHRASES, key.cast("string"))


def chat(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with one such phrase at the end: ``(doc_id, lang, source, text)``."""
    docs = load_spread(spark, sf, DOCUMENTS, "doc_id", "lang", "source", "text")
    return docs.withColumn("text", F.concat("text", F.lit(" "), phrase_of(F.col("doc_id"))))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as chat messages; the first word of a turn is its author's name."""
    turns = load_spread(spark, sf, CONVERSATIONS, "conv_id", "turn", "text")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return turns.select(
        key.alias("id"),
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("seq"),
        F.col("conv_id").cast("string").alias("room"),
        F.concat("text", F.lit(" "), phrase_of(key)).alias("text"),
        F.regexp_extract("text", "[A-Za-z]+", 0).alias("username"),
        ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("is_audio"),
        ((F.col("conv_id") + F.col("turn")) % 11 != 0).alias("guard_on"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with gate hits, lexicon scores and offensive score."""
    docs = load_spread(spark, sf, DOCUMENTS, "doc_id", "lang", "source", "text")
    h = F.col("h")
    return (
        docs.withColumn("h", lx.gate_count(F.lower("text"), TERMS).cast("bigint"))
        .withColumn("scores", sc.score_list(Not_offensive=1 / (h + 1), Profanity=h / (h + 1)))
        .withColumn("offensive", sc.fold_scores(F.col("scores"), ["Not_offensive", "Not_in_intended_language"]))
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with truth and prediction."""
    truth = load(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "Offensive").otherwise("Not_offensive").alias("true_label")
    )
    gated = F.when((F.col("h") > 0) & (F.col("offensive") < sc.THRESHOLD), sc.GATE_SCORE).otherwise(F.col("offensive"))
    guess = (
        scored(spark, sf)
        .select("doc_id", "lang", sc.rounded(gated).alias("offensive_score"))
        .withColumn("predicted", F.when(sc.is_offensive(F.col("offensive_score")), "Offensive").otherwise("Not_offensive"))
    )
    joined = guess.join(truth, "doc_id")
    return joined.withColumn("correct", F.col("true_label") == F.col("predicted"))


# Raw label per document: from its source and hash, some unknown, one class rare.
RAW = [
    "Not_offensive",
    "not-malayalam",
    "Offensive_Targeted_Insult_Group",
    "Offensive_Untargetede",
    "Offensive_Targeted_Insult_Individual",
    "Profanity",
    "Off_target_ind",
    "unknown-label",
]


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a labelled corpus ``(doc_id, text, label, extra, seq)``; some labels are missing."""
    docs = load(spark, sf, DOCUMENTS).select("doc_id", "text")
    h = tx.hash_int(F.concat(F.lit("label:"), F.col("doc_id").cast("string")))
    label = F.element_at(F.array(*[F.lit(r) for r in RAW]), (h % len(RAW) + 1).cast("int"))
    return docs.select(
        "doc_id",
        "text",
        F.when(h % 23 != 0, label).alias("label"),
        F.when(h % 5 == 0, "feedback").when(h % 5 == 1, "user_classify").otherwise("seed").alias("extra"),
        F.col("doc_id").alias("seq"),
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as actions on documents; some point at no document."""
    n = load(spark, sf, DOCUMENTS).agg(F.count("*")).scalar()
    e = load(spark, sf, "events").select("event_id", "ts", "event_type")
    kind = F.when(F.col("event_type") == "error", "report").when(F.col("event_type") == "click", "reveal").otherwise("classify")
    value = (
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "Profanity")
        .when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, " Hate_Speech ").otherwise("hate_speech"))
        .when(F.col("event_type") == "purchase", "not_hate_speech")
        .when(F.col("event_type") == "view", "maybe")
    )
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_id") * 7919) % (n + F.floor(n / 5))).cast("string").alias("message_id"),
        kind.alias("kind"),
        value.alias("value"),
    )


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as classified messages ``(id, text, label, offensive_score, is_offensive)``."""
    bad = sc.is_offensive(F.col("offensive"))
    return scored(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"),
        "text",
        "lang",
        F.when(F.col("h") > 1, "Profanity").otherwise("Not_offensive").alias("label"),
        sc.rounded(F.col("offensive")).alias("offensive_score"),
        bad.alias("is_offensive"),
    )


# -- the same in SQL -----------------------------------------------------------------


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


SPACE = tx.SPACE
WORD = tx.WORD_CHARS


def sql_hash(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def sql_pick(options: list[str], x: str) -> str:
    return f"({sql_list(options)})[{sql_hash(x)} % {len(options)} + 1]"


SQL_SPACES = "(" + " || ".join(f"chr({ord(ch)})" for ch in tx.SPACE_CHARS) + ")"


def sql_strip(x: str) -> str:
    return f"trim({x}, {SQL_SPACES})"


def sql_key(x: str) -> str:
    return f"lower({sql_strip(x)})"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(SPACE + '+')}), lambda t: t <> '')"


def sql_join(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def sql_collapse(source: str, key: str, keep: int) -> str:
    """A query ``(key, text)``: a character goes if it equals the ``keep`` characters before it."""
    before = ", ".join(f"lag(c, {k}) OVER w AS p{k}" for k in range(1, keep + 1))
    same = " AND ".join(f"c IS NOT DISTINCT FROM p{k}" for k in range(1, keep + 1))
    return f"""SELECT {key}, string_agg(c, '' ORDER BY place) AS text FROM (
  SELECT {key}, c, place, {before} FROM (
    SELECT {key}, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS place FROM {source})
  WINDOW w AS (PARTITION BY {key} ORDER BY place))
WHERE c = chr(10) OR NOT ({same}) GROUP BY {key}"""


def gate_sql(terms: list[str] = TERMS) -> str:
    bodies = [f"{SPACE}*".join(ch + "+" for ch in t) for t in terms]
    return lit("(?:" + "|".join(bodies) + ")")


CHAT = f"""chat AS (
  SELECT doc_id, lang, source, text || ' ' || {sql_pick(PHRASES, 'doc_id::VARCHAR')} AS text FROM documents)"""
MESSAGES = f"""messages AS (
  SELECT conv_id || '-' || turn AS id, conv_id * 1000000 + turn AS seq, conv_id::VARCHAR AS room,
    text || ' ' || {sql_pick(PHRASES, "(conv_id || '-' || turn)")} AS text,
    regexp_extract(text, '[A-Za-z]+') AS username,
    (conv_id + turn) % 7 = 0 AS is_audio, (conv_id + turn) % 11 <> 0 AS guard_on
  FROM conversations)"""
SCORED = f"""hits AS (
  SELECT doc_id, lang, source, text, len(regexp_extract_all(lower(text), {gate_sql()})) AS h FROM documents),
scored AS (SELECT *, 1.0::DOUBLE - 1.0::DOUBLE / (h + 1) AS offensive FROM hits)"""
VERDICTS = SCORED + """,
guess AS (
  SELECT doc_id, lang,
    round_even(CASE WHEN h > 0 AND offensive < 0.8::DOUBLE THEN 0.99::DOUBLE ELSE offensive END, 4) AS offensive_score
  FROM scored),
verdicts AS (
  SELECT doc_id, lang, offensive_score,
    CASE WHEN offensive_score > 0.8::DOUBLE THEN 'Offensive' ELSE 'Not_offensive' END AS predicted,
    CASE WHEN toxic = 1 THEN 'Offensive' ELSE 'Not_offensive' END AS true_label,
    (toxic = 1) = (offensive_score > 0.8::DOUBLE) AS correct
  FROM guess JOIN labels USING (doc_id))"""
_LABEL_HASH = sql_hash("'label:' || doc_id")
CORPUS = f"""corpus AS (
  SELECT doc_id, text,
    CASE WHEN {_LABEL_HASH} % 23 <> 0 THEN ({sql_list(RAW)})[{_LABEL_HASH} % {len(RAW)} + 1] END AS label,
    CASE {_LABEL_HASH} % 5 WHEN 0 THEN 'feedback' WHEN 1 THEN 'user_classify' ELSE 'seed' END AS extra,
    doc_id AS seq
  FROM documents)"""
ACTIONS = """actions AS (
  SELECT event_id AS seq, ts,
    ((event_id * 7919) % (SELECT count(*) + count(*) // 5 FROM documents))::VARCHAR AS message_id,
    CASE event_type WHEN 'error' THEN 'report' WHEN 'click' THEN 'reveal' ELSE 'classify' END AS kind,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Profanity'
      WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN ' Hate_Speech ' ELSE 'hate_speech' END
      WHEN event_type = 'purchase' THEN 'not_hate_speech' WHEN event_type = 'view' THEN 'maybe' END AS value
  FROM events)"""
CLASSIFIED = SCORED + """,
classified AS (
  SELECT doc_id::VARCHAR AS id, text, lang, CASE WHEN h > 1 THEN 'Profanity' ELSE 'Not_offensive' END AS label,
    round_even(offensive, 4) AS offensive_score, offensive > 0.8::DOUBLE AS is_offensive
  FROM scored)"""


def sql_label_dim() -> str:
    from wardline.operators.labels import LABELS

    rows = ", ".join(
        f"({lit(raw)}, {lit(canonical)}, {i}::INTEGER, {lit(display)}, {lit(severity)}, {str(safe).upper()})"
        for raw, canonical, i, display, severity, safe in LABELS
    )
    return f"label_dim(raw, canonical, label_id, display, severity, is_safe) AS (VALUES {rows})"


LABEL_DIM = sql_label_dim()
LEXICON = "lexicon(term, pos) AS (VALUES " + ", ".join(f"({lit(t)}, {i}::INTEGER)" for i, t in enumerate(TERMS)) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
