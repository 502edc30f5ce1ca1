"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.hard_negatives import hard_negatives, labelled_vectors
from wardline.llm.jaccard_join import jaccard_join
from wardline.llm.language_id import language_id
from wardline.llm.line_dedup import line_dedup
from wardline.llm.packing import best_fit_packing, token_pieces
from wardline.llm.piece_tokens import encode
from wardline.llm.pivot_search import top_k, whole_vectors
from wardline.llm.quality_rules import quality_rules
from wardline.llm.sentence_dedup import sentence_dedup
from wardline.llm.sharding import assign
from wardline.llm.suffix_dedup import suffix_dedup
from wardline.llm.transcripts import parse_transcripts, raw_transcripts
from wardline.llm.whitening import whiten


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return best_fit_packing(pieces.drop("ids"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir, "documents"), keep_bytes=False)


def op3_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup(_read(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "n_sentences", "n_removed", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_read(spark, sf_dir, "documents"))


def op6_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(_read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_transcripts(raw_transcripts(_read(spark, sf_dir, "conversations")))


def op8_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False).drop("ids")


SHARD_BYTES = 1 << 20


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(_read(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select(F.col("key").alias("doc_id"), F.col("bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "shard", "page")


OP9_SQL = f"""
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
nodes AS (
  SELECT doc_id, n_bytes, depth, hash >> (60 - depth) AS node,
    sum(n_bytes) OVER (PARTITION BY depth, hash >> (60 - depth)) AS held
  FROM hashed CROSS JOIN (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS depth))
SELECT doc_id, n_bytes, min(depth) AS depth, arg_min((CAST(1 AS BIGINT) << depth) + node, depth) AS shard, CAST(0 AS BIGINT) AS page
FROM nodes WHERE held <= {SHARD_BYTES} GROUP BY doc_id, n_bytes
"""


OP6_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
members AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingles
  FROM texts),
named AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS class, shingles FROM members),
classes AS (
  SELECT class, min(n) AS n, min(doc_id) AS first, any_value(shingles) AS shingles
  FROM named WHERE n > 0 AND doc_id IS NOT NULL GROUP BY class),
held AS (SELECT first, n, unnest(shingles) AS shingle FROM classes),
links AS (
  SELECT a.first AS a, b.first AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.first <> b.first
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
  SELECT first AS node, first AS root FROM classes
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node WHERE r.root < l.b),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(r.root, m.doc_id) AS component_id
FROM named m LEFT JOIN classes c ON m.class = c.class AND m.n > 0 AND m.doc_id IS NOT NULL LEFT JOIN roots r ON r.node = c.first
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(_read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_read(spark, sf_dir, "documents"), with_text=False)


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, len(parts) AS n_lines, unnest(parts) AS line, unnest(range(len(parts))) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (
  SELECT k.*, coalesce(k.doc_id <> r.first, false) AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, CAST(min(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(labelled_vectors(_read(spark, sf_dir, "embeddings"), label=moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sentence_dedup": op3_sentence_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_pivot_search": op6_pivot_search,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_piece_tokens": op8_piece_tokens,
    "op9_sharding": op9_sharding,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op6_pivot_search": OP6_SQL, "op9_sharding": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op12_line_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
