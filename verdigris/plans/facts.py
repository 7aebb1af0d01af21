"""Views over the star schema in the shape of evaluation tables, so that every operator has whole tables to run on.

The SQL texts run unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS_SQL = """
SELECT l_orderkey, l_linenumber,
 concat('prov', CAST(l_suppkey % 6 AS STRING)) AS provider_id,
 concat('model', CAST(l_suppkey % 16 AS STRING)) AS model,
 CAST(1 + l_linenumber % 3 AS BIGINT) AS run,
 concat(CASE l_partkey % 5 WHEN 0 THEN 'clean-speech-' WHEN 1 THEN 'hard-' WHEN 2 THEN 'code-switching-'
        WHEN 3 THEN 'whispered-lowquality-' ELSE 'number-formatting-' END,
        CASE l_partkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'auto' END) AS suite_id,
 concat('en-', CASE l_orderkey % 6 WHEN 0 THEN 'fast-' WHEN 1 THEN 'numbers-' WHEN 2 THEN 'tech-'
        WHEN 3 THEN 'names-' WHEN 4 THEN 'breakfast-' ELSE 'noisy-' END, CAST(l_partkey % 40 AS STRING)) AS test_id,
 CASE WHEN l_linenumber = 7 OR l_suppkey % 16 = 5 THEN 'skipped' WHEN l_discount >= 0.09 THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN l_discount >= 0.09 AND l_linenumber <> 7 THEN 'Timeout' END AS error,
 CASE WHEN l_partkey % 7 = 0 THEN 'librispeech' WHEN l_partkey % 7 = 1 THEN 'custom' END AS test_source,
 l_discount * 5 AS wer_normalized, l_tax AS cer,
 CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 10 END AS punctuation_score,
 CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 8 END AS formatting_score,
 l_extendedprice AS duration_ms,
 CASE WHEN l_quantity > 0 THEN l_extendedprice / (l_quantity * 1000) ELSE 0 END AS realtime_factor,
 CASE WHEN l_suppkey % 16 = 3 THEN 0 ELSE l_quantity * 1000 END AS audio_duration_ms,
 CASE WHEN l_suppkey % 6 < 3 THEN l_extendedprice / 1000000 END AS cost_usd
FROM lineitem"""

PROVIDERS_SQL = "SELECT DISTINCT concat('prov', CAST(s_suppkey % 6 AS STRING)) AS provider_id, CASE WHEN s_suppkey % 6 < 3 THEN 'cloud' WHEN s_suppkey % 6 = 3 THEN 'local' ELSE 'system' END AS provider_type FROM supplier WHERE s_suppkey % 6 <> 5"

#: Suite files that know some suites better than their rows do.
EXISTING_SQL = """
SELECT 'hard-de' AS suite_id, 'Hard Cases' AS name, CAST(NULL AS STRING) AS description, 'de' AS language, 'technical-jargon' AS category,
 'core' AS tier, 'public' AS origin, CAST(1000 AS BIGINT) AS test_count
UNION ALL SELECT 'clean-speech-en', '', 'Read aloud', 'en', 'clean-speech', 'core', CAST(NULL AS STRING), CAST(NULL AS BIGINT)
UNION ALL SELECT 'unused-de', 'Unused', 'No rows', 'de', 'long-form-speech', 'core', 'synthetic', CAST(0 AS BIGINT)"""

#: What earlier runs have left in the cache: two of three tests' first two runs, some of them failed.
CACHED_SQL = """
SELECT suite_id, test_id, provider_id, model, run, CASE WHEN n % 16 = 0 THEN 'Timeout' END AS error
FROM (SELECT DISTINCT concat('suite', CAST(p_partkey % 18 AS STRING)) AS suite_id, concat('t-', CAST(p_partkey AS STRING)) AS test_id, p_partkey AS n FROM part WHERE p_partkey % 3 <> 0)
CROSS JOIN (SELECT DISTINCT concat('prov', CAST(s_suppkey % 6 AS STRING)) AS provider_id, concat('model', CAST(s_suppkey % 16 AS STRING)) AS model FROM supplier)
CROSS JOIN (VALUES (1), (2)) AS runs(run)"""

TESTS_SQL = """
SELECT concat('suite', CAST(p_partkey % 18 AS STRING)) AS suite_id, concat('t-', CAST(p_partkey AS STRING)) AS test_id,
 concat('audio/', CAST(p_partkey AS STRING), '.wav') AS audio_file, CASE p_partkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'auto' END AS language,
 CAST(p_size AS DOUBLE) * 3 AS duration_seconds FROM part"""
MODELS_SQL = """
SELECT DISTINCT concat('prov', CAST(s_suppkey % 6 AS STRING)) AS provider_id, concat('model', CAST(s_suppkey % 16 AS STRING)) AS model, s_suppkey % 2 = 0 AS supports_auto, s_suppkey % 16 AS m16 FROM supplier"""


def _views(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, FACTS_SQL, "lineitem")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, PROVIDERS_SQL, "supplier")


def existing_suites(spark: SparkSession) -> DataFrame:
    return spark.sql(EXISTING_SQL)


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, TESTS_SQL, "part")


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier")}
    return spark.sql(CACHED_SQL.replace("FROM part", "FROM {part}").replace("FROM supplier", "FROM {supplier}"), **of)


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some models take all languages (null), some German and English, some English alone."""
    m = _views(spark, sf_dir, MODELS_SQL, "supplier")
    some = F.when(F.col("m16") % 4 == 1, F.array(F.lit("de"), F.lit("en"))).when(F.col("m16") % 4 == 2, F.array(F.lit("en")))
    return m.select("provider_id", "model", "supports_auto", some.alias("languages"))


#: Words of an utterance.
UTTERANCE = 30


def spread(d: DataFrame) -> DataFrame:
    """Rows of a table of a few files dealt out, so that all cores have some; a table of many parts stays as it is."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= 4 * cores else d.repartition(4 * cores)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and hypotheses from documents: every text as utterances of 30 words, and the same with every seventh word missed."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "lang", "text"))
    words = F.array_remove(F.split(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "), " "), "")
    # no filter: Spark would split all texts before they are dealt out, in the few tasks that read the files
    d = d.select("doc_id", "lang", words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(UTTERANCE))
    parts = F.when(F.size("w") > 0, F.transform(starts, lambda i: F.slice("w", i, UTTERANCE)))
    d = d.select("doc_id", "lang", F.posexplode(parts).alias("i", "rw")).withColumn("hw", F.filter("rw", lambda x, i: i % 7 != 3))
    return d.select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("utt"), "lang", "rw", "hw", F.array_join("rw", " ").alias("ref"), F.array_join("hw", " ").alias("hyp"))


UTTERANCES_SQL = r"""
SELECT utt, lang, rw, hw, array_to_string(rw, ' ') AS ref, array_to_string(hw, ' ') AS hyp FROM (
 SELECT *, list_filter(rw, lambda x, i: i % 7 <> 4) AS hw FROM (
  SELECT doc_id * 1000000 + (i - 1) // 30 AS utt, lang, w[i:i + 29] AS rw FROM (
   SELECT *, unnest(range(1, len(w) + 1, 30)) AS i FROM (
    SELECT doc_id, lang, list_filter(string_split(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL))))"""
