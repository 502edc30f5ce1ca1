"""Curation, splits, generation and training on the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.bindings import base as b
from wardline.bindings.base import corpus, lit, load, load_spread, query, with_
from wardline.functions import scores as sc
from wardline.functions import text as tx
from wardline.operators import curation as cu
from wardline.operators import generation as ge
from wardline.operators import labels as lb
from wardline.operators import splits as sp
from wardline.plans import counting as ct
from wardline.plans import scoring as so
from wardline.plans import training as tr
from wardline.session import materialise, scratch_dir

# -- rows --------------------------------------------------------------------------------


@query("drop_unlabelled", with_(b.CORPUS) + "SELECT doc_id, label FROM corpus WHERE text IS NOT NULL AND label IS NOT NULL")
def drop_unlabelled(spark, sf):
    return cu.drop_unlabelled(corpus(spark, sf)).select("doc_id", "label")


@query("dedupe_last", with_(b.CORPUS) + "SELECT text, arg_max(label, seq) AS label, max(seq) AS seq FROM corpus WHERE label IS NOT NULL GROUP BY text")
def dedupe_last(spark, sf):
    rows = cu.drop_unlabelled(corpus(spark, sf)).select("text", "label", "seq")
    return cu.keep_last(rows, ["text"], ["seq"])


@query(
    "dedupe_first",
    f"""SELECT text, doc_id, lang, source FROM (SELECT {b.sql_strip('text')} AS text, doc_id, lang, source,
  row_number() OVER (PARTITION BY {b.sql_strip('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def dedupe_first(spark, sf):
    docs = load(spark, sf, "documents").select(tx.strip(F.col("text")).alias("text"), "doc_id", "lang", "source")
    return cu.keep_first(docs, ["text"], ["doc_id"])


SOURCES = f"""user_chat AS (SELECT text, 'Not_offensive' AS label, 'user_chat' AS extra, doc_id AS seq FROM documents),
feedback AS (SELECT text, CASE WHEN toxic = 1 THEN 'Profanity' ELSE 'Not_offensive' END AS label, 'user_feedback' AS extra, doc_id AS seq
  FROM labels JOIN documents USING (doc_id)),
together AS (
  SELECT text, label, extra, seq, 'corpus' AS source, CASE WHEN extra IN ('feedback', 'user_classify') THEN 2 ELSE 0 END AS source_rank FROM corpus
  UNION ALL SELECT text, label, extra, seq, 'user_chat', 1 FROM user_chat
  UNION ALL SELECT text, label, extra, seq, 'feedback', 2 FROM feedback)"""


def sources(spark, sf):
    """Three sources on the same texts; each source has its own labels."""
    docs = load(spark, sf, "documents").select("doc_id", "text", "source")
    chat = docs.select(
        "text", F.lit("Not_offensive").alias("label"), F.lit("user_chat").alias("extra"), F.col("doc_id").alias("seq")
    )
    truth = load(spark, sf, "labels").select("doc_id", "toxic").join(docs, "doc_id")
    feedback = truth.select(
        "text",
        F.when(F.col("toxic") == 1, "Profanity").otherwise("Not_offensive").alias("label"),
        F.lit("user_feedback").alias("extra"),
        F.col("doc_id").alias("seq"),
    )
    return {"corpus": corpus(spark, sf).select("text", "label", "extra", "seq"), "user_chat": chat, "feedback": feedback}


@query("union_sources", with_(b.CORPUS, SOURCES) + "SELECT text, label, extra, seq, source, source_rank::INTEGER AS source_rank FROM together")
def union_sources(spark, sf):
    return cu.union_sources({**sources(spark, sf), "missing": None})


CURATED = SOURCES + f""",
latest AS (SELECT text, label, extra, seq, source, source_rank FROM (SELECT *,
    row_number() OVER (PARTITION BY text ORDER BY source_rank DESC, seq DESC, source DESC) AS rn FROM together WHERE label IS NOT NULL) WHERE rn = 1),
{b.LABEL_DIM},
mapped AS (SELECT l.*, canonical AS mapped_label FROM latest l JOIN label_dim ON raw = label),
curated AS (SELECT * FROM mapped WHERE mapped_label IN (SELECT mapped_label FROM mapped GROUP BY 1 HAVING count(*) >= 2))"""


def curated(spark, sf):
    """The whole curation; ties between sources of one rank go to the later source name."""
    return tr.curate(sources(spark, sf), lb.label_dim(spark))


@query("curated_corpus", with_(b.CORPUS, CURATED) + "SELECT text, label, extra, seq, source, source_rank::INTEGER AS source_rank, mapped_label FROM curated")
def curated_corpus(spark, sf):
    return curated(spark, sf)


@query("label_distribution", with_(b.CORPUS, CURATED) + "SELECT mapped_label, count(*) AS n FROM curated GROUP BY 1")
def label_distribution(spark, sf):
    return cu.label_distribution(curated(spark, sf))


# A class label that has a single document.
RARE = "CASE WHEN doc_id = (SELECT max(doc_id) FROM documents) THEN 'odd one out' ELSE lang END"


@query(
    "rare_class_filter",
    with_(f"t AS (SELECT doc_id, {RARE} AS label FROM documents)")
    + "SELECT doc_id, label FROM t WHERE label IN (SELECT label FROM t GROUP BY 1 HAVING count(*) >= 2)",
)
def rare_class_filter(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    last = docs.agg(F.max("doc_id")).scalar()
    rows = docs.select("doc_id", F.when(F.col("doc_id") == last, "odd one out").otherwise(F.col("lang")).alias("label"))
    return cu.drop_rare(rows, "label")


@query("chronological", "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations")
def chronological(spark, sf):
    ordered = cu.chronological(load(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return _numbered(ordered)


def _numbered(ordered):
    """Number an ordered frame without gathering it: offsets per partition, then places within."""
    rows = ordered.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    rows = materialise(rows, "ordered")  # both uses below must see the same partitions
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_row") + 1
    return rows.join(offsets, "_part").withColumn("place", place).drop("_id", "_part", "_row", "_before")


@query("shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id)) AS place FROM documents")
def shuffle(spark, sf):
    return _numbered(cu.shuffle(load(spark, sf, "documents").select("doc_id"), "doc_id", 7))


@query(
    "top1",
    """SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars,
  row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1""",
)
def top1(spark, sf):
    return cu.top1(load(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"])


@query(
    "first_match",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""",
)
def first_match(spark, sf):
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    return cu.first_match(rows, ["conv_id"], "turn")


# -- leakage and sets: the documents of some sources against those of the others, without dedupe first --

PARTS = """test AS (SELECT doc_id, text FROM documents WHERE source < 'src12'),
train AS (SELECT doc_id, '  ' || lower(text) || ' ' AS text FROM documents WHERE source >= 'src12')"""
KEY = b.sql_key("text")


def parts(spark, sf):
    """Both parts; training texts differ from their copies in case and outer space."""
    docs = load(spark, sf, "documents").select("doc_id", "text", "source")
    is_test = F.col("source") < "src12"
    train = docs.filter(~is_test).withColumn("text", F.concat(F.lit("  "), F.lower("text"), F.lit(" ")))
    return docs.filter(is_test).drop("source"), train.drop("source")


@query("overlap", with_(PARTS) + f"SELECT doc_id FROM test WHERE {KEY} IN (SELECT {KEY} FROM train)")
def overlap(spark, sf):
    return cu.overlap(*parts(spark, sf)).select("doc_id")


@query("remove_overlap", with_(PARTS) + f"SELECT doc_id, text FROM test WHERE {KEY} NOT IN (SELECT {KEY} FROM train)")
def remove_overlap(spark, sf):
    return cu.remove_overlap(*parts(spark, sf))


@query("intersect_texts", with_(PARTS) + f"SELECT {KEY} AS text FROM test INTERSECT SELECT {KEY} FROM train")
def intersect_texts(spark, sf):
    return cu.intersect_texts(*parts(spark, sf))


@query(
    "subtract_texts",
    "SELECT doc_id, text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
)
def subtract_texts(spark, sf):
    """Documents whose text no labelled document has."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(load(spark, sf, "labels"), "doc_id", "left_semi")
    return cu.subtract_texts(docs, labelled)


# -- splits ------------------------------------------------------------------------------------


def _split_sql(source: str, label: str, frac: str, key: str = "text") -> str:
    """Exact sizes by largest remainders, then the first rows of each class by hash."""
    return f"""cnt AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1),
tot AS (SELECT *, sum(n) OVER ()::BIGINT AS total, (sum(n) OVER () - ceil(sum(n) OVER () * {frac}::DOUBLE))::BIGINT AS train FROM cnt),
flo AS (SELECT *, n * train // total AS fl, n * train % total AS rest FROM tot),
siz AS (SELECT label, n - fl - (row_number() OVER (ORDER BY rest DESC, label) <= train - sum(fl) OVER ())::INT AS k FROM flo),
rnk AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('99:' || {key}), {key}) AS rn FROM {source}),
assigned AS (SELECT r.*, rn <= k AS is_holdout FROM rnk r JOIN siz s ON s.label = r.{label})"""


@query("stratified_split", with_(b.CORPUS, CURATED, _split_sql("curated", "mapped_label", "0.2")) + "SELECT text, mapped_label, is_holdout FROM assigned")
def stratified_split(spark, sf):
    assigned = sp.assign_split(curated(spark, sf), "text", "mapped_label", 0.2, 99)
    return assigned.select("text", "mapped_label", "is_holdout")


@query(
    "validation_split",
    with_("d AS (SELECT doc_id, 0 AS one FROM documents)", _split_sql("d", "one", "0.05", "doc_id")) + "SELECT doc_id, is_holdout FROM assigned",
)
def validation_split(spark, sf):
    train, held = sp.split(load(spark, sf, "documents").select("doc_id"), "doc_id", 0.05, 99)
    return train.withColumn("is_holdout", F.lit(False)).unionByName(held.withColumn("is_holdout", F.lit(True)))


@query(
    "split_sizes",
    with_(b.CORPUS, CURATED, _split_sql("curated", "mapped_label", "0.2"))
    + "SELECT CASE WHEN is_holdout THEN 'holdout' ELSE 'train' END AS split, count(*) AS n FROM assigned GROUP BY 1",
)
def split_sizes(spark, sf):
    train, holdout = sp.stratified_split(curated(spark, sf), "text", "mapped_label")
    return cu.split_sizes({"train": train, "holdout": holdout})


# -- generation -----------------------------------------------------------------------------------

SAFE_TEMPLATES = [
    "{who} {verb} the {thing}",
    "{who} was {mood} about the {thing}",
    "the {thing} is {mood} , {who}",
    "has {who} seen the {thing} at {place} ?",
    "{who} {verb} at {place}",
    "{mood} news : {who} {verb} early",
]
SAFE_SLOTS = {
    "who": ["the astronomer", "a beekeeper", "the choir", "our captain", "the gardener"],
    "verb": ["polished", "sketched", "measured", "repaired"],
    "thing": ["telescope", "violin", "canoe", "lantern", "barometer", "loom"],
    "mood": ["curious", "patient", "windswept", "cheerful"],
    "place": ["the observatory", "the harbour", "the vineyard", "the lighthouse"],
}
OFFENSIVE_TEMPLATES = ["{who} is a {degree} {term}", "what a {term} {who} is", "{degree} {term} , that is {who}", "go away {term}", "{who} , you {term}"]
OFFENSIVE_SLOTS = {
    "who": ["that fellow", "your crew", "the skipper", "your cousin"],
    "degree": ["dreadful", "shameless", "towering", "notorious"],
    "term": b.TERMS,
}


def _render_sql(templates: list[str], slots: dict[str, list[str]], seed: int, key: str) -> str:
    choose = lambda options, name: b.sql_pick(options, f"('{seed}:{name}:' || {key})")
    x = choose(templates, "template")
    for name, options in slots.items():
        x = f"replace({x}, '{{{name}}}', {choose(options, name)})"
    return b.sql_strip(x)


GENERATED = f"""generated AS (
  SELECT doc_id AS id, {_render_sql(SAFE_TEMPLATES, SAFE_SLOTS, 7, 'doc_id')} AS text, 'Not_offensive' AS true_label FROM documents
  UNION ALL SELECT event_id, {_render_sql(OFFENSIVE_TEMPLATES, OFFENSIVE_SLOTS, 7, 'event_id')}, 'Offensive' FROM events)"""


def generated(spark, sf):
    """One safe row per document and one offensive row per event."""
    safe = ge.generate_from(load(spark, sf, "documents"), "doc_id", SAFE_TEMPLATES, SAFE_SLOTS, "Not_offensive", 7)
    bad = ge.generate_from(load(spark, sf, "events"), "event_id", OFFENSIVE_TEMPLATES, OFFENSIVE_SLOTS, "Offensive", 7)
    return cu.union_generated(safe, bad)


@query("generate_templates", with_(GENERATED) + "SELECT * FROM generated")
def generate_templates(spark, sf):
    return generated(spark, sf)


_TRAIN_ROW = _render_sql(SAFE_TEMPLATES, SAFE_SLOTS, 8, "o_orderkey")


@query(
    "leakfree_generate",
    with_(GENERATED, f"seen AS (SELECT {_TRAIN_ROW} AS text FROM orders)")
    + f"SELECT id, text, true_label FROM generated WHERE {KEY} NOT IN (SELECT {KEY} FROM seen)",
)
def leakfree_generate(spark, sf):
    """Generated rows that do not occur among the rows of another seed, one per order."""
    seen = ge.generate_from(load(spark, sf, "orders"), "o_orderkey", SAFE_TEMPLATES, SAFE_SLOTS, "Not_offensive", 8)
    return ge.unseen(generated(spark, sf), seen)


# -- training -----------------------------------------------------------------------------------------


@query(
    "training_prep",
    with_(b.CORPUS, b.LABEL_DIM)
    + """SELECT text, label, extra, seq, canonical AS mapped_label, label_id FROM (
  SELECT text, arg_max(label, seq) AS label, arg_max(extra, seq) AS extra, max(seq) AS seq FROM corpus WHERE label IS NOT NULL GROUP BY text)
JOIN label_dim ON raw = label""",
)
def training_prep(spark, sf):
    return tr.training_prep(corpus(spark, sf).drop("doc_id"), lb.label_dim(spark))


@query(
    "truncate_tokens",
    f"SELECT doc_id, len(t) AS n, {b.sql_join('t')} AS text FROM (SELECT doc_id, list_slice({b.sql_tokens('text')}, 1, 64) AS t FROM documents)",
)
def truncate_tokens(spark, sf):
    docs = tr.truncate_tokens(load_spread(spark, sf, "documents", "doc_id", "text"))
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("n"), tx.join_tokens(F.col("tokens")).alias("text"))


TERM_BUCKETS = f"""worded AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
spelled AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM worded),
counts AS (SELECT doc_id, ({b.sql_hash('term')} % {ct.BUCKETS})::INTEGER AS bucket, count(*) AS tf FROM spelled GROUP BY 1, 2)"""


@query(
    "train_features",
    with_(TERM_BUCKETS)
    + """SELECT doc_id, bucket, tf, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*) OVER (PARTITION BY bucket))::DOUBLE) + 1, 9) AS idf
FROM counts""",
)
def train_features(spark, sf):
    """Hashed term counts of every document and the IDF of their buckets."""
    docs = ct.hashed(load_spread(spark, sf, "documents", "doc_id", "text"), "text")
    idf = ct.bucket_idf(ct.count_terms(docs.select("text", F.lit("all").alias("label"))))
    # At most one row a bucket.
    return ct.term_counts(docs, "doc_id", "text").join(F.broadcast(idf), "bucket").select("doc_id", "bucket", "tf", F.round("idf", 9).alias("idf"))


LEARNED = """labelled AS (SELECT doc_id, label FROM corpus WHERE text IS NOT NULL AND label IS NOT NULL),
sums AS (
  SELECT label, bucket, count(*) AS docs, sum(tf)::BIGINT AS terms FROM counts JOIN labelled USING (doc_id) GROUP BY ALL
  UNION ALL SELECT label, -1, count(*), sum(coalesce(len(w) + greatest(len(w) - 1, 0), 0))::BIGINT FROM labelled JOIN worded USING (doc_id) GROUP BY label)"""


@query("train_goes_on", with_(b.CORPUS, TERM_BUCKETS, LEARNED) + "SELECT label, bucket::INTEGER AS bucket, docs, terms FROM sums")
def train_goes_on(spark, sf):
    """Training on two thirds of the corpus, saved and continued with the rest; the second batch runs twice."""
    path = scratch_dir(spark, "sums")
    rows = ct.hashed(corpus(spark, sf).select("doc_id", "text", "label"), "text")
    ct.go_on_training(rows.filter("doc_id % 3 <> 0"), path, 0)
    ct.go_on_training(rows.filter("doc_id % 3 = 0"), path, 1)
    return ct.go_on_training(rows.filter("doc_id % 3 = 0"), path, 1)


# Hashing documents apart: a fifth of the labelled ones is held out.
HELD = f"({b.sql_hash("'held:' || doc_id")} % 5 = 0)"
TOXIC = """truth AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Profanity' ELSE 'Not_offensive' END AS label FROM labels JOIN documents USING (doc_id))"""
COUNTED = f"""fit AS (SELECT * FROM truth WHERE NOT {HELD}),
classes AS (SELECT label, count(*) AS size, (SELECT count(*) FROM fit) AS texts FROM fit GROUP BY label),
inside AS (SELECT label, bucket, count(*) AS docs FROM counts JOIN fit USING (doc_id) GROUP BY ALL),
cells AS (SELECT label, size, texts, bucket, coalesce(docs, 0) + 0.5::DOUBLE AS a, df - coalesce(docs, 0) + 0.5::DOUBLE AS z
  FROM (SELECT bucket, sum(docs) AS df FROM inside GROUP BY bucket) CROSS JOIN classes LEFT JOIN inside USING (label, bucket)),
weights AS (SELECT label, bucket, (ln(a / (size + 1)) - ln(z / (texts - size + 1))) / 2 AS weight FROM cells
  WHERE abs(ln(a / (size + 1)) - ln(z / (texts - size + 1))) >= {ct.SURE}::DOUBLE * sqrt(1 / a + 1 / z)),
found AS (SELECT doc_id, label, sum(weight) AS weight FROM counts JOIN weights USING (bucket) GROUP BY ALL),
odds AS (SELECT doc_id, label, ln(size / texts::DOUBLE) + coalesce(weight, 0) AS odds
  FROM documents CROSS JOIN classes LEFT JOIN found USING (doc_id, label))"""


@query(
    "train_predict",
    with_(TERM_BUCKETS, TOXIC, COUNTED)
    + f"""SELECT doc_id, {HELD} AS held_out, round(1 / (1 + exp(least(max(odds) FILTER (label = 'Not_offensive') - max(odds) FILTER (label = 'Profanity'), 700))), 6) AS offensive
FROM odds GROUP BY doc_id""",
)
def train_predict(spark, sf):
    """Train on four fifths of the labelled documents, then score every document."""
    docs = load_spread(spark, sf, "documents", "doc_id", "text")
    held = tx.hash_int(F.concat(F.lit("held:"), F.col("doc_id").cast("string"))) % 5 == 0
    truth = load(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "Profanity").otherwise("Not_offensive").alias("label"))
    sums = materialise(ct.count_terms(docs.filter(~held).join(truth, "doc_id").select("text", "label")), "sums")
    scored = ct.count_scores(docs.withColumn("held_out", held), "doc_id", "text", sums)
    return scored.select("doc_id", "held_out", F.round(sc.fold_scores(F.col("scores"), lb.SAFE_LABELS), 6).alias("offensive"))


@query("train_logistic")
def train_logistic(spark, sf):
    """A logistic regression on four fifths of the labelled documents, scoring every document."""
    docs = load_spread(spark, sf, "documents", "doc_id", "text")
    held = tx.hash_int(F.concat(F.lit("held:"), F.col("doc_id").cast("string"))) % 5 == 0
    truth = load(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, 3).otherwise(0).alias("label_id"))
    model = tr.fit_classifier(docs.filter(~held).join(truth, "doc_id").select("text", "label_id"), features=1 << 14, max_iter=10)
    scored = so.pipeline_scorer(model)(docs.withColumn("held_out", held), "text")
    return scored.select("doc_id", "held_out", sc.rounded(sc.fold_scores(F.col("scores"), lb.SAFE_LABELS)).alias("offensive"))
