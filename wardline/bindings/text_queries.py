"""Normalisation, predicates and lexicon matching on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.bindings import base as b
from wardline.bindings import oracle_text as o
from wardline.bindings.base import chat, lit, load, load_spread, messages, query, scored, with_
from wardline.functions import romanise as ro
from wardline.functions import scores as sc
from wardline.functions import text as tx
from wardline.operators import lexicon as lx
from wardline.operators import messages as ms
from wardline.operators import rules as rl
from wardline.operators import users as us
from wardline.plans import classify as cl
from wardline.plans import normalise as nm
from wardline.plans import scoring as so

LOWERED = "low AS (SELECT doc_id, lower(text) AS text FROM chat)"


def lowered(spark, sf):
    return chat(spark, sf).select("doc_id", F.lower("text").alias("text"))


def inline_lexicon(spark):
    return lx.load_lexicon(b.lexicon(spark))


@query(
    "flagged_rate_by_lang",
    with_(b.SCORED)
    + """SELECT lang, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6)::DOUBLE AS share FROM (
  SELECT lang, CASE WHEN off <= 0.8::DOUBLE THEN 'safe' WHEN off < 0.95::DOUBLE THEN 'high' ELSE 'extreme' END AS bucket FROM (
    SELECT lang, CASE WHEN h > 0 AND offensive < 0.8::DOUBLE THEN 0.99::DOUBLE ELSE offensive END AS off FROM scored))
GROUP BY lang, bucket""",
)
def flagged_rate_by_lang(spark, sf):
    """What share of the documents per language is offensive, and how badly."""
    df = scored(spark, sf).withColumn("safe", 1 - F.col("offensive"))
    counts = cl.apply_gate(df, F.col("h") > 0).groupBy("lang", sc.bucket(F.col("offensive")).alias("bucket")).agg(
        F.count("*").alias("n")
    )
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(total, "lang").select("lang", "bucket", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("norm_key", f"SELECT conv_id, turn, {b.sql_key('text')} AS key, {b.sql_key(lit('  ') + ' || role || chr(10)')} AS role FROM conversations")
def norm_key(spark, sf):
    turns = load(spark, sf, "conversations")
    padded = F.concat(F.lit("  "), "role", F.lit("\n"))
    return turns.select("conv_id", "turn", tx.norm_key(F.col("text")).alias("key"), tx.norm_key(padded).alias("role"))


@query("lowercase", "SELECT doc_id, lower(text) AS text FROM documents")
def lowercase(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))


@query("word_rules", with_(b.CHAT, LOWERED) + f"SELECT doc_id, {o.word_rules('text', b.RULES + b.LATE_RULES)} AS text FROM low")
def word_rules(spark, sf):
    return rl.apply_rules(lowered(spark, sf), "text", b.RULES + b.LATE_RULES)


@query("phrase_rule", with_(b.CHAT, LOWERED) + f"SELECT doc_id, {o.phrase('text', b.PHRASE)} AS text FROM low")
def phrase_rule(spark, sf):
    return rl.apply_rules(lowered(spark, sf), "text", [b.PHRASE])


@query("context_rules", with_(b.CHAT, LOWERED) + f"SELECT doc_id, {o.context('text', b.FORMS, b.CONTEXT, 'dog')} AS text FROM low")
def context_rules(spark, sf):
    return rl.context_rules(lowered(spark, sf), "text", b.FORMS, b.CONTEXT, "dog")


@query("prefix_context", with_(b.CHAT, LOWERED) + f"SELECT doc_id, {o.article('text', b.ARTICLES, b.FORMS, 'dog')} AS text FROM low")
def prefix_context(spark, sf):
    return rl.prefix_context(lowered(spark, sf), "text", b.ARTICLES, b.FORMS, "dog")


@query("capture_rule", with_(b.CHAT, LOWERED) + f"SELECT doc_id, {o.compare('text', b.LINK, b.VERBS, b.TAIL)} AS text FROM low")
def capture_rule(spark, sf):
    return rl.capture_rule(lowered(spark, sf), "text", b.LINK, b.VERBS, b.TAIL)


@query(
    "strip_prefixes",
    with_(
        b.CHAT, LOWERED, b.LEXICON, o.index("lexicon"), o.tokens_of("low", "doc_id", "t"), "v AS (SELECT DISTINCT token FROM t)",
        o.prefixes("v", "m", b.PREFIXES), o.regroup("low", "doc_id", "t", "m", "done"),
    )
    + "SELECT doc_id, text FROM done",
)
def strip_prefixes(spark, sf):
    return lx.strip_prefixes(lowered(spark, sf), "text", inline_lexicon(spark), b.PREFIXES)


@query(
    "drop_before_term",
    with_(b.CHAT, LOWERED, f"w AS (SELECT doc_id, {b.sql_tokens('text')} AS toks FROM low)")
    + f"SELECT doc_id, {b.sql_join(o.drop_before('toks', b.DROPPED, b.TERMS))} AS text FROM w",
)
def drop_before_term(spark, sf):
    return lx.drop_before_term(lowered(spark, sf), "text", inline_lexicon(spark), b.DROPPED)


@query("collapse_runs3", with_(b.CHAT) + b.sql_collapse("chat", "doc_id", 2))
def collapse_runs3(spark, sf):
    return chat(spark, sf).select("doc_id", tx.collapse_runs(F.col("text"), 3, 2).alias("text"))


@query("collapse_runs2", with_(b.CHAT) + b.sql_collapse("chat", "doc_id", 1))
def collapse_runs2(spark, sf):
    return chat(spark, sf).select("doc_id", tx.collapse_runs(F.col("text"), 2, 1).alias("text"))


@query("tokens", f"SELECT doc_id, len({b.sql_tokens('text')}) AS n, {b.sql_join(b.sql_tokens('text'))} AS text FROM documents")
def tokens(spark, sf):
    words = tx.tokens(F.col("text"))
    docs = load_spread(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", F.size(words).cast("bigint").alias("n"), tx.join_tokens(words).alias("text"))


@query("mask_words", with_(b.CHAT, LOWERED) + f"SELECT doc_id, {o.mask('text', b.EXCEPTIONS + ['und', 'que'])} AS text FROM low")
def mask_words(spark, sf):
    return rl.mask_words(lowered(spark, sf), "text", b.EXCEPTIONS + ["und", "que"])


def _mask_users_sql(room: str) -> str:
    return with_(
        b.MESSAGES,
        f"""users AS (SELECT {room} AS scope, lower(username) AS name, min(seq) AS first_seen FROM messages
  WHERE username <> '' AND lower(username) <> 'guest' GROUP BY ALL)""",
        f"cut AS (SELECT id, seq, {room} AS scope, {o.pieces('lower(text)')} AS parts FROM messages)",
        "flat AS (SELECT id, seq, scope, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS place FROM cut)",
        """named AS (SELECT id, place, CASE WHEN u.name IS NOT NULL AND u.first_seen <= f.seq THEN 'friend' ELSE part END AS part
  FROM flat f LEFT JOIN users u ON u.scope = f.scope AND u.name = f.part)""",
    ) + "SELECT id, string_agg(part, '' ORDER BY place) AS text FROM named GROUP BY id"


def _mask_users(spark, sf, room):
    msgs = messages(spark, sf)
    users = us.first_seen(msgs, room)
    low = msgs.withColumn("text", F.lower("text"))
    return us.mask_active_users(low, users, "text", "id", room).select("id", "text")


@query("mask_active_users", _mask_users_sql("room"))
def mask_active_users(spark, sf):
    return _mask_users(spark, sf, "room")


@query("mask_active_users_everywhere", _mask_users_sql("0"))
def mask_active_users_everywhere(spark, sf):
    return _mask_users(spark, sf, None)


@query(
    "users_as_of",
    with_(
        b.MESSAGES,
        "users AS (SELECT lower(username) AS name, min(seq) AS first_seen FROM messages WHERE username <> '' GROUP BY 1)",
        f"flat AS (SELECT DISTINCT id, seq, unnest({o.pieces('lower(text)')}) AS part FROM messages)",
    )
    + "SELECT id, name FROM flat JOIN users ON name = part AND first_seen <= seq WHERE name <> 'guest'",
)
def users_as_of(spark, sf):
    msgs = messages(spark, sf).withColumn("text", F.lower("text"))
    found = us.users_as_of(msgs, us.first_seen(msgs), "text")
    return found.select("id", F.explode("names").alias("name"))


LATIN = "abcdefghijklmnopqrstuvwxyz"
# One sign per letter: consonants, vowel signs and a virama in between, so every rule has work.
SIGNS = "ാബചദേഫഗഹിജകലമനോപഖരസതുവംഷയ്"


def _romanise_sql() -> str:
    spelled = "CASE c " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in ro.CHAR_MAP.items()) + " ELSE c END"
    silent = sorted(ro.VOWEL_SIGNS) + [ro.VIRAMA]
    inherent = (
        f"CASE WHEN c IN {b.sql_in(sorted(ro.CONSONANTS))} AND coalesce(chars[i + 1] NOT IN {b.sql_in(silent)}, true) THEN 'a' ELSE '' END"
    )
    return (
        with_(f"src AS (SELECT doc_id, string_split(translate(lower(text), {lit(LATIN)}, {lit(SIGNS)}), '') AS chars FROM documents)")
        + f"SELECT doc_id, array_to_string(list_transform(chars, lambda c, i: {spelled} || {inherent}), '') AS text FROM src"
    )


@query("romanise", _romanise_sql())
def romanise(spark, sf):
    docs = load_spread(spark, sf, "documents", "doc_id", "text")
    script = docs.select("doc_id", F.translate(F.lower("text"), LATIN, SIGNS).alias("text"))
    return script.withColumn("text", ro.romanise(F.col("text")))


@query("normalise", with_(b.CHAT, o.full_normaliser("chat", "doc_id", "done", b)) + "SELECT doc_id, text FROM done")
def normalise(spark, sf):
    return nm.normalise(chat(spark, sf).select("doc_id", "text"), "text", b.normaliser_settings(spark), "doc_id")


@query("normalise_by_joins", with_(b.MESSAGES, o.full_normaliser("messages", "id", "done", b)) + "SELECT id, text FROM done")
def normalise_by_joins(spark, sf):
    """The plan for a lexicon too large for literals."""
    msgs = messages(spark, sf).select("id", "text")
    return nm.normalise(msgs, "text", b.normaliser_settings(spark, inline_limit=0), "id")


@query(
    "audio_branch",
    with_(b.MESSAGES, o.full_normaliser("messages", "id", "norm", b))
    + f"SELECT id, CASE WHEN is_audio THEN {b.sql_strip('m.text')} ELSE n.text END AS processed FROM messages m JOIN norm n USING (id)",
)
def audio_branch(spark, sf):
    """What the classifier scores: typed messages normalised, audio only stripped."""
    settings = cl.ClassifierSettings(b.normaliser_settings(spark), so.lexicon_scorer(b.TERMS))
    return cl.process(messages(spark, sf).select("id", "text", "is_audio"), settings).select("id", "processed")


# -- predicates --------------------------------------------------------------------

BLANKS = "CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) || chr(9) WHEN 2 THEN '' ELSE '  ' || text || ' ' END"


@query(
    "valid_messages",
    with_(f"m AS (SELECT conv_id, turn, {BLANKS} AS text FROM conversations)")
    + f"SELECT conv_id, turn, {b.sql_strip('text')} AS text FROM m WHERE coalesce({b.sql_strip('text')}, '') <> ''",
)
def valid_messages(spark, sf):
    part = F.col("conv_id") % 5
    text = (
        F.when(part == 0, F.lit(None).cast("string"))
        .when(part == 1, F.lit(" \n\t"))
        .when(part == 2, F.lit(""))
        .otherwise(F.concat(F.lit("  "), "text", F.lit(" ")))
    )
    return ms.valid_messages(load(spark, sf, "conversations").select("conv_id", "turn", text.alias("text")))


@query("gate_hits", with_(b.SCORED) + "SELECT doc_id, h > 0 AS hit, h AS hits FROM scored")
def gate_hits(spark, sf):
    docs = load_spread(spark, sf, "documents", "doc_id", "text").withColumn("text", F.lower("text"))
    hits = lx.gate_count(F.col("text"), b.TERMS).cast("bigint")
    return docs.select("doc_id", lx.gate_hit(F.col("text"), b.TERMS).alias("hit"), hits.alias("hits"))


@query("gate_hits_by_joins", with_(b.SCORED) + "SELECT doc_id, h AS hits FROM scored")
def gate_hits_by_joins(spark, sf):
    """The same count with the lexicon as a table of any length."""
    docs = load_spread(spark, sf, "documents", "doc_id", "text").withColumn("text", F.lower("text"))
    found = lx.gate_by_joins(docs, "doc_id", "text", b.lexicon(spark))
    return found.select("doc_id", F.col("hits").cast("bigint").alias("hits"))


@query("gate_hits_by_trie", with_(b.SCORED) + "SELECT doc_id, h AS hits FROM scored")
def gate_hits_by_trie(spark, sf):
    """The same count with the lexicon as a trie that texts are walked through."""
    docs = load_spread(spark, sf, "documents", "doc_id", "text").withColumn("text", F.lower("text"))
    found = lx.gate_by_table(docs, "doc_id", "text", b.lexicon(spark))
    return found.select("doc_id", F.col("hits").cast("bigint").alias("hits"))


@query("gate_short_terms", f"SELECT doc_id, regexp_matches(lower(text), {b.gate_sql(['thea', 'ndon', 'ereri'])}) AS hit FROM documents")
def gate_short_terms(spark, sf):
    """Terms that occur inside and across ordinary words: there is no word boundary."""
    docs = load_spread(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", lx.gate_hit(F.lower("text"), ["thea", "ndon", "ereri"]).alias("hit"))


LOOPS = """SELECT doc_id, 'whole' AS kind, text FROM documents
  UNION ALL SELECT doc_id, 'loop', repeat(substr(text, 1, 3), 8) FROM documents
  UNION ALL SELECT doc_id, 'short', substr(text, 1, 15) FROM documents"""


@query(
    "hallucination",
    with_(f"t AS ({LOOPS})")
    + """SELECT doc_id, kind, CASE WHEN length(text) > 15 AND len(list_distinct(string_split(text, ''))) < 8 THEN '' ELSE text END AS text,
  len(list_distinct(string_split(text, ''))) AS distinct_chars FROM t""",
)
def hallucination(spark, sf):
    """Whole texts, and of each a looping and a short one."""
    kinds = {"whole": F.col("text"), "loop": F.repeat(F.substring("text", 1, 3), F.lit(8)), "short": F.substring("text", 1, 15)}
    docs = load_spread(spark, sf, "documents", "doc_id", "text")
    docs = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in kinds.items()))))
    return docs.select(
        "doc_id",
        "kind",
        tx.suppress_hallucination(F.col("text")).alias("text"),
        tx.distinct_chars(F.col("text")).cast("bigint").alias("distinct_chars"),
    )


@query(
    "neutral_intercept",
    with_(b.MESSAGES, f"words AS (SELECT DISTINCT unnest({b.sql_tokens('text')}) AS id FROM messages)", "said AS (SELECT id, id AS text FROM words)",
          o.full_normaliser("said", "id", "norm", b))
    + f"""SELECT id, text AS processed, {b.sql_strip('text')} = 'friend' AS safe,
  CASE WHEN {b.sql_strip('text')} = 'friend' THEN 0.0::DOUBLE END AS offensive_score FROM norm""",
)
def neutral_intercept(spark, sf):
    """Every word of the conversations as a message of its own, through the classifier."""
    words = lx.distinct_tokens(messages(spark, sf), "text").select(F.col("token").alias("id"), F.col("token").alias("text"))
    said = words.withColumns({"seq": F.lit(0).cast("long"), "is_audio": F.lit(False), "guard_on": F.lit(True)})
    found = cl.classify(said, cl.ClassifierSettings(b.normaliser_settings(spark), so.lexicon_scorer(b.TERMS)))
    safe = F.col("path") == "intercept"
    return found.select("id", "processed", safe.alias("safe"), F.when(safe, F.col("offensive_score")).alias("offensive_score"))


# -- lexicon -----------------------------------------------------------------------

TOKENS = f"""tok AS (SELECT DISTINCT {o.collapse_token('token', 2)} AS token FROM (
  SELECT DISTINCT unnest({b.sql_tokens('lower(text)')}) AS token FROM chat))"""


def clean_tokens(spark, sf):
    """The distinct lower-case tokens of the chat texts, long runs cut."""
    words = lx.distinct_tokens(lowered(spark, sf), "text")
    return words.select(tx.collapse_runs(F.col("token")).alias("token")).distinct()


BENCH_LEXICON = f"""bench AS (SELECT term, min(item_id)::INTEGER AS pos FROM (
  SELECT item_id, unnest({b.sql_tokens('lower(text)')}) AS term FROM benchmark) GROUP BY term)"""


@query("ngram_index", with_(BENCH_LEXICON, o.index("bench")) + "SELECT term, pos, gram, df, round(idf, 6) AS idf, round(w, 6) AS w FROM idx")
def ngram_index(spark, sf):
    """An index over the vocabulary of the benchmark texts."""
    rows = load(spark, sf, "benchmark").select("item_id", F.explode(tx.tokens(F.lower("text"))).alias("term"))
    terms = rows.groupBy("term").agg(F.min("item_id").cast("int").alias("pos"))
    idx = lx.fit_ngram_index(terms)
    return idx.select("term", "pos", "gram", "df", F.round("idf", 6).alias("idf"), F.round("w", 6).alias("w"))


@query(
    "nearest_term",
    with_(b.CHAT, TOKENS, b.LEXICON, o.index("lexicon"), o.nearest("tok", "near")) + "SELECT token, term, round(sim, 6) AS sim FROM near",
)
def nearest_term(spark, sf):
    near = lx.nearest_term(clean_tokens(spark, sf), lx.fit_ngram_index(b.lexicon(spark)))
    return near.select("token", "term", F.round("sim", 6).alias("sim"))


@query(
    "nearest_term_inline",
    with_(b.CHAT, TOKENS, b.LEXICON, o.index("lexicon"), o.nearest("tok", "near")) + "SELECT token, term FROM near",
)
def nearest_term_inline(spark, sf):
    term = lx.nearest_in(F.col("token"), inline_lexicon(spark))
    return clean_tokens(spark, sf).withColumn("term", term).filter(F.col("term").isNotNull())


@query(
    "suffix_match",
    with_(b.CHAT, TOKENS, b.LEXICON, o.index("lexicon"), o.stems("tok", "st", b.SUFFIXES)) + "SELECT token, term FROM st",
)
def suffix_match(spark, sf):
    lexicon = b.lexicon(spark)
    return lx.nearest_term_stemmed(clean_tokens(spark, sf), lx.fit_ngram_index(lexicon), lexicon, b.SUFFIXES)


@query("phonetic_match", with_(b.CHAT, TOKENS, b.LEXICON, o.sounds("tok", "z")) + "SELECT token, term FROM z")
def phonetic_match(spark, sf):
    return lx.phonetic_match(clean_tokens(spark, sf), b.lexicon(spark))


@query("exceptions", with_(b.CHAT, TOKENS) + f"SELECT token FROM tok WHERE token NOT IN {b.sql_in(b.EXCEPTIONS)}")
def exceptions(spark, sf):
    return lx.bypass(clean_tokens(spark, sf), b.exceptions(spark))


@query(
    "in_lexicon",
    with_(b.CHAT, TOKENS, b.LEXICON)
    + f"""SELECT token FROM tok WHERE token IN (SELECT term FROM lexicon)
  OR {o.collapse_token('token', 1)} IN (SELECT {o.collapse_token('term', 1)} FROM lexicon)""",
)
def in_lexicon(spark, sf):
    return lx.in_lexicon(clean_tokens(spark, sf), b.lexicon(spark))


FUZZY = with_(b.CHAT, b.LEXICON, o.index("lexicon"), o.cascade("chat", "doc_id", "done", b.EXCEPTIONS, b.SUFFIXES)) + "SELECT doc_id, text FROM done"


@query("fuzzy_map", FUZZY)
def fuzzy_map(spark, sf):
    df = chat(spark, sf).select("doc_id", "text")
    return lx.fuzzy_map(df, "text", b.lexicon(spark), b.exceptions(spark), "doc_id", b.SUFFIXES)


@query("fuzzy_map_by_joins", FUZZY)
def fuzzy_map_by_joins(spark, sf):
    df = chat(spark, sf).select("doc_id", "text")
    return lx.fuzzy_map(df, "text", b.lexicon(spark), b.exceptions(spark), "doc_id", b.SUFFIXES, limit=0)


@query(
    "fuzzy_map_silent",
    with_(b.CHAT, b.LEXICON, o.index("lexicon"), o.cascade("chat", "doc_id", "done", b.EXCEPTIONS, b.SUFFIXES, phonetic=False))
    + "SELECT doc_id, text FROM done",
)
def fuzzy_map_silent(spark, sf):
    """Without matching by sound."""
    df = chat(spark, sf).select("doc_id", "text")
    return lx.fuzzy_map(df, "text", b.lexicon(spark), b.exceptions(spark), "doc_id", b.SUFFIXES, phonetic=False)


@query(
    "phonetic_hit_rate",
    with_(b.CHAT, TOKENS, b.LEXICON, o.sounds("tok", "z"))
    + "SELECT z.term, count(*) AS n_tokens, round(count(*) / (SELECT count(*) FROM tok), 6)::DOUBLE AS share FROM z GROUP BY z.term",
)
def phonetic_hit_rate(spark, sf):
    """How much of the vocabulary the permissive sound step would catch, per term."""
    words = clean_tokens(spark, sf)
    total = words.agg(F.count("*")).scalar()
    hits = lx.phonetic_match(words, b.lexicon(spark)).groupBy("term").agg(F.count("*").alias("n_tokens"))
    return hits.withColumn("share", F.round(F.col("n_tokens") / total, 6))
