"""The queries of this subpackage and their SQL, by name. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .bpe import encode_documents
from .chat import format_conversations
from .common import table
from .html import extract_pages
from .negatives import mine_negatives
from .neighbours import score_quality
from .packing import pack_documents
from .secrets import scan_secrets
from .simhash import near_duplicates
from .suffix import remove_repeats
from .tokencount import count_tokens
from .topk import exact_top_k
from .trie import prefix_trie


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score_documents(table(spark, sf_dir, "documents"))
    return scores.drop("class_distance", "word_distance")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = e.select("vec_id", "embedding", label.alias("label"))
    return mine_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len({x}) + 1), lambda i: ascii({x}[i])::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::BIGINT)"""
OP12_SQL = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, conv_id - conv_id % 20 AS base_id, ({CRC32_SQL.format(x="(conv_id::VARCHAR)")} % 4)::BIGINT AS h FROM own),
full_ AS (SELECT h.conv_id, list_concat(coalesce(own.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own ON own.conv_id = h.base_id),
p AS (SELECT conv_id, t[1:d] AS path, d AS depth, len(t) AS n FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM full_)),
nodes AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256,
  CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM p GROUP BY path, depth),
kids AS MATERIALIZED (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
n2 AS MATERIALIZED (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
up AS (SELECT path[1:d] AS path, n_children, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n2)),
sums AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY path)
SELECT n2.conv_id, n2.depth, above.conv_id AS parent_conv_id, n2.n_convs, n2.n_children, n_leaves, saved_tokens, n2.ends_sha256
FROM n2 JOIN sums ON sums.path = n2.path LEFT JOIN nodes above ON n2.depth > 0 AND above.path = n2.path[1:n2.depth - 1]"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_secrets, op3_quality, op4_packing, op5_top_k, op6_chat, op7_token_counts, op8_main_text, op9_bpe_codec, op10_suffix_dedup, op11_hard_negatives, op12_prefix_trie, op13_quality_votes)
}
ORACLE_SQL: dict[str, str] = {"op3_quality": quality.oracle_sql(), "op5_top_k": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
