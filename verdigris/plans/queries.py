"""One query for every operator family, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, sql, text, words
from ..operators import curate, dims, merge, predicates, rankings, state, views, worklist
from ..sources import folders, readers, result_files, sinks, snapshots
from ..sources.cache import CacheTable, buckets_for
from .facts import CACHED_SQL, EXISTING_SQL, FACTS_SQL, MODELS_SQL, PROVIDERS_SQL, TESTS_SQL, UTTERANCES_SQL, cached, existing_suites, facts, models, providers, spread, tests, utterances

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, by the same steps as in ``six``: what lies halfway must not hang on an engine's own rounding."""
    return df.select(*[(F.floor(F.col(c) * 1e6 + 0.5).cast("double") / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def six(x: str) -> str:
    return f"(floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE)::DOUBLE / 1e6::DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rankings -----------------------------------------------------------------------------------------------------

SKIP, ERR = "status IS NOT DISTINCT FROM 'skipped'", "(status IS NOT DISTINCT FROM 'error' OR coalesce(error, '') <> '')"
VALID = f"(NOT {SKIP} AND NOT {ERR})"
BASE = f"WITH facts AS ({FACTS_SQL}), providers AS ({PROVIDERS_SQL})"
CATEGORY_SQL = "CASE " + " ".join(f"WHEN starts_with(suite_id, '{p}') THEN '{c}'" for p, c in dims.CATEGORY_BY_PREFIX.items()) + " ELSE 'clean-speech' END"
LANGUAGE_SQL = "coalesce(nullif(regexp_extract(suite_id, '-(de|en|auto)$', 1), ''), 'de')"
PUBLIC_SQL = "(" + ", ".join(f"'{s}'" for s in dims.PUBLIC_SOURCES) + ")"


def measures() -> str:
    v = f"FILTER (WHERE {VALID})"
    n = f"count(*) {v} = 0"

    def total(c: str) -> str:
        return f"CAST(sum(CAST({c} AS DECIMAL(38, 9))) {v} AS DOUBLE)"

    def mean(c: str) -> str:
        return f"{total(c)} / count({c}) {v}"

    return f"""
 {six(f"CASE WHEN {n} THEN 1 ELSE {mean('wer_normalized')} END")} AS avg_wer, {six(f"CASE WHEN {n} THEN 1 ELSE {mean('cer')} END")} AS avg_cer,
 CAST(NULL AS DOUBLE) AS avg_semantic, {six(mean('punctuation_score'))} AS avg_punctuation, {six(mean('formatting_score'))} AS avg_formatting,
 {six(f"CASE WHEN {n} THEN 0 ELSE {mean('realtime_factor')} END")} AS avg_rtf, {six(f"CASE WHEN {n} THEN 0 ELSE {mean('duration_ms')} END")} AS avg_duration_ms,
 {six(f"CASE WHEN {total('audio_duration_ms')} <> 0 THEN {total('coalesce(cost_usd, 0)')} / {total('audio_duration_ms')} * 3600000 END")} AS cost_per_hour, count(*) AS total_tests,
 count(*) FILTER (WHERE {ERR}) AS error_count,
 {six(f"CASE WHEN count(*) > count(*) FILTER (WHERE {SKIP}) THEN CAST(count(*) FILTER (WHERE {ERR}) AS DOUBLE) / (count(*) - count(*) FILTER (WHERE {SKIP})) ELSE 0 END")} AS error_rate,
 count(*) FILTER (WHERE {SKIP}) AS skip_count"""


def ranking_sql(source: str, *scope: str, more: str = "") -> str:
    s = "".join(f"{c}, " for c in scope)
    part = f"PARTITION BY {', '.join(scope)} " if scope else ""
    return f"""{BASE}{more}, g AS (SELECT {s}provider_id, model, {measures()} FROM {source} GROUP BY {s}provider_id, model)
SELECT g.*, coalesce(provider_type, 'cloud') AS provider_type, row_number() OVER ({part}ORDER BY round(avg_wer, 6), g.provider_id, model) AS rank
FROM g LEFT JOIN providers ON g.provider_id = providers.provider_id"""


WITH_CATEGORY = f"(SELECT *, {CATEGORY_SQL} AS category FROM facts)"
SLICE_ROWS = " UNION ALL ".join(f"SELECT *, '{s}' AS slice FROM facts WHERE regexp_matches(test_id, '{p}')" for s, p in predicates.SLICES.items())


def _dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.suites_of_results(facts(spark, sf_dir))


@query(ranking_sql("facts"))
def rank_global(spark, sf_dir):
    return rounded(rankings.rank_models(facts(spark, sf_dir), providers=providers(spark, sf_dir)))


@query(ranking_sql("facts", "suite_id"))
def rank_by_suite(spark, sf_dir):
    return rounded(rankings.rank_models(facts(spark, sf_dir), "suite_id", providers=providers(spark, sf_dir)))


@query(ranking_sql(WITH_CATEGORY, "category"))
def rank_by_category(spark, sf_dir):
    return rounded(rankings.rank_by_category(facts(spark, sf_dir), _dim(spark, sf_dir), providers(spark, sf_dir)))


@query(ranking_sql(f"({SLICE_ROWS})", "slice"))
def rank_by_slice(spark, sf_dir):
    return rounded(rankings.rank_by_slice(facts(spark, sf_dir), providers(spark, sf_dir)))


@query(f"""{BASE}, f AS (SELECT *, {CATEGORY_SQL} AS category FROM facts)
SELECT CASE WHEN grouping(category) = 1 AND grouping(suite_id) = 1 THEN 'global' WHEN grouping(category) = 0 THEN 'category' ELSE 'suite' END AS grain,
 category, suite_id, provider_id, model, {measures()} FROM f GROUP BY GROUPING SETS ((provider_id, model), (category, provider_id, model), (suite_id, provider_id, model))""")
def rank_grouping_sets(spark, sf_dir):
    return rounded(rankings.rank_grains(facts(spark, sf_dir), _dim(spark, sf_dir)))


# --- the suite dimension ------------------------------------------------------------------------------------------

LABEL_SQL = "CASE language WHEN 'de' THEN ' (German)' WHEN 'en' THEN ' (English)' ELSE ' (Auto)' END"
NAME_SQL = (
    "CASE WHEN category = 'code-switching' THEN CASE WHEN language = 'auto' THEN 'Code-Switching (auto-detect)' ELSE 'Code-Switching (DE hint)' END "
    + " ".join(f"WHEN category = '{c}' THEN concat('{n}', {LABEL_SQL})" for c, n in dims.NAME_BY_CATEGORY.items())
    + f" WHEN starts_with(suite_id, 'hard-') THEN concat('Hard Cases', {LABEL_SQL}) ELSE suite_id END"
)
DIM_SQL = f"""(SELECT suite_id, {NAME_SQL} AS name, concat('Legacy suite metadata inferred for ', suite_id) AS description, language, category,
 CASE WHEN starts_with(suite_id, 'hard-') OR category IN ('code-dictation', 'code-switching') THEN 'diagnostic' ELSE 'core' END AS tier,
 CASE WHEN n_source > 0 AND public OR n_source = 0 AND (starts_with(suite_id, 'clean-speech-') OR starts_with(suite_id, 'accented-speech-') OR category = 'long-form-speech') THEN 'public' ELSE 'synthetic' END AS origin, test_count
 FROM (SELECT suite_id, {LANGUAGE_SQL} AS language, {CATEGORY_SQL} AS category, count(test_source) AS n_source, bool_and(test_source IN {PUBLIC_SQL}) AS public, count(DISTINCT test_id) AS test_count FROM facts GROUP BY suite_id))"""
DIM_BASE = f"{BASE}, dim AS {DIM_SQL}, existing AS ({EXISTING_SQL})"


def _overlay_sql(join: str, own: str = "e.{c}") -> str:
    cols = ", ".join(f"coalesce({own.format(c='test_count', z='0') if c == 'test_count' else own.format(c=c, z=chr(39) * 2)}, d.{c}) AS {c}" for c in dims.COLUMNS)
    return f"{DIM_BASE} SELECT coalesce(d.suite_id, e.suite_id) AS suite_id, {cols} FROM dim d {join} JOIN existing e ON d.suite_id = e.suite_id"


@query(f"{DIM_BASE} SELECT * FROM dim")
def suite_metadata(spark, sf_dir):
    return _dim(spark, sf_dir)


@query(_overlay_sql("LEFT"))
def suite_metadata_overlay(spark, sf_dir):
    return dims.overlay(_dim(spark, sf_dir), existing_suites(spark))


@query(_overlay_sql("FULL", "nullif(e.{c}, {z})"))
def suite_metadata_outer(spark, sf_dir):
    return dims.overlay(_dim(spark, sf_dir), existing_suites(spark), keep_empty_suites=True, empty_is_missing=True)


@query(f"""{DIM_BASE} SELECT count(*) AS total_models, (SELECT CAST(sum(test_count) AS BIGINT) FROM dim) AS total_tests,
 (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM dim) AS languages, (SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM dim) AS categories
 FROM (SELECT DISTINCT provider_id, model FROM facts)""")
def summary_metadata(spark, sf_dir):
    return rankings.summary_metadata(_dim(spark, sf_dir), rankings.rank_models(facts(spark, sf_dir)))


@query(f"{BASE} SELECT CAST(CASE WHEN bool_and(provider_type IN ('local', 'system')) THEN 1 ELSE 10 END AS BIGINT) AS concurrency FROM providers")
def concurrency_rule(spark, sf_dir):
    return rankings.concurrency(providers(spark, sf_dir))


WRITES_SQL = "SELECT concat('suite', CAST(c_custkey % 20 AS STRING)) AS suite_id, c_name AS name, c_mktsegment AS description, c_custkey AS file_ord FROM customer"


@query(f"SELECT suite_id, name, description FROM ({WRITES_SQL}) QUALIFY row_number() OVER (PARTITION BY suite_id ORDER BY file_ord DESC) = 1")
def metadata_last_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("suite"), F.col("c_custkey") % 20).alias("suite_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.col("c_custkey").alias("file_ord"))
    return dims.last_writer_wins(c, "file_ord")


# --- views --------------------------------------------------------------------------------------------------------

LISTED = f"{BASE}, dim AS {DIM_SQL}, kept AS (SELECT * FROM dim WHERE tier = 'core')"


def _view_sql(where: str, dim_where: str = "tier = 'core'") -> str:
    return ranking_sql(f"(SELECT * FROM facts WHERE suite_id IN (SELECT suite_id FROM dim WHERE {dim_where}) AND {where})", more=f", dim AS {DIM_SQL}")


def _view(spark, sf_dir, f: views.ViewFilters) -> DataFrame:
    return rounded(views.view_rankings(facts(spark, sf_dir), _dim(spark, sf_dir), f, providers(spark, sf_dir)))


@query(_view_sql("true"))
def view_default(spark, sf_dir):
    return _view(spark, sf_dir, views.ViewFilters())


@query(_view_sql("true", "language = 'de' AND category = 'clean-speech'"))
def view_category(spark, sf_dir):
    return _view(spark, sf_dir, views.ViewFilters("category", "clean-speech", tier="all", language="de"))


@query(_view_sql("suite_id = 'hard-en'", "tier = 'diagnostic'"))
def view_suite(spark, sf_dir):
    return _view(spark, sf_dir, views.ViewFilters("suite", "hard-en", tier="diagnostic"))


@query(_view_sql("regexp_matches(test_id, '(^|-)fast-')", "origin = 'synthetic'"))
def view_slice(spark, sf_dir):
    return _view(spark, sf_dir, views.ViewFilters("slice", "fast-speech", tier="all", origin="synthetic"))


@query(f"""{LISTED}, r AS (SELECT * FROM facts WHERE suite_id IN (SELECT suite_id FROM kept)),
s AS (SELECT DISTINCT slice AS value, CASE slice {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(predicates.SLICES))} END AS i, CASE slice {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in views.SLICE_TITLES.items())} END AS label FROM ({SLICE_ROWS.replace('FROM facts', 'FROM r')}))
SELECT 'category' AS kind, row_number() OVER (ORDER BY category)::INTEGER AS ordinal, category AS value, category AS label FROM (SELECT DISTINCT category FROM kept)
UNION ALL SELECT 'suite', row_number() OVER (ORDER BY lower(name), suite_id)::INTEGER, suite_id, name FROM kept UNION ALL SELECT 'slice', row_number() OVER (ORDER BY i)::INTEGER, value, label FROM s""")
def scope_options(spark, sf_dir):
    return views.scope_options(facts(spark, sf_dir), _dim(spark, sf_dir), views.ViewFilters())


@query(f"{LISTED} SELECT CAST(coalesce(sum(test_count), 0) AS BIGINT) AS visible_tests FROM kept")
def visible_tests(spark, sf_dir):
    return views.visible_tests(_dim(spark, sf_dir), views.ViewFilters())


@query(f"{BASE} SELECT bool_or(regexp_matches(test_id, '(^|-)fast-')) AS fast, bool_or(regexp_matches(test_id, '(^|-)numbers-')) AS numbers, bool_or(regexp_matches(test_id, '(^|-)tech-')) AS tech, bool_or(regexp_matches(test_id, '(^|-)names-')) AS names FROM facts")
def slice_exists(spark, sf_dir):
    f = facts(spark, sf_dir)
    short = {"fast-speech": "fast", "numbers-dates": "numbers", "technical-jargon": "tech", "proper-nouns": "names"}
    return f.agg(*[F.bool_or(F.col("test_id").rlike(p)).alias(short[s]) for s, p in predicates.SLICES.items()])


GLOBAL = ranking_sql("facts")


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CASE WHEN (({x}) * {2 ** (digits + 1)}) % 2 = 1 THEN {x} + 1e-9 ELSE {x} END)"


@query(f"SELECT provider_id, model, CAST({fixed('avg_wer * 100', 1)} AS DOUBLE) AS wer_percent FROM ({GLOBAL})")
def chart_accuracy(spark, sf_dir):
    return views.accuracy_chart(rank_global(spark, sf_dir))


@query(f"SELECT provider_id, model, CAST({fixed('avg_rtf', 3)} AS DOUBLE) AS avg_rtf FROM ({GLOBAL})")
def chart_speed(spark, sf_dir):
    return views.speed_chart(rank_global(spark, sf_dir))


@query(f"SELECT provider_id, model, CASE WHEN cost_per_hour IS NULL THEN 0 ELSE CAST({fixed('cost_per_hour', 2)} AS DOUBLE) END AS cost, coalesce(cost_per_hour, 0) = 0 AS free FROM ({GLOBAL})")
def chart_cost(spark, sf_dir):
    return views.cost_chart(rank_global(spark, sf_dir))


@query(f"SELECT bool_or(avg_punctuation IS NOT NULL) AS has_punctuation, bool_or(avg_formatting IS NOT NULL) AS has_formatting, bool_or(skip_count > 0) AS has_skips FROM ({GLOBAL})")
def leaderboard_flags(spark, sf_dir):
    return views.leaderboard_flags(rank_global(spark, sf_dir))


PERCENT = {c: f"concat({fixed(f'{c} * 100', 1)}, '%')" for c in ("avg_wer", "avg_cer", "avg_punctuation", "avg_formatting")}


@query(f"""WITH r AS ({GLOBAL}), f AS (SELECT bool_or(avg_punctuation IS NOT NULL) AS p, bool_or(avg_formatting IS NOT NULL) AS q, bool_or(skip_count > 0) AS s FROM r)
SELECT rank, concat(provider_id, '/', model) AS model, provider_type AS type, {PERCENT['avg_wer']} AS wer, {PERCENT['avg_cer']} AS cer,
 CASE WHEN p THEN CASE WHEN avg_punctuation IS NULL THEN '-' ELSE {PERCENT['avg_punctuation']} END END AS punctuation,
 CASE WHEN q THEN CASE WHEN avg_formatting IS NULL THEN '-' ELSE {PERCENT['avg_formatting']} END END AS formatting,
 concat({fixed('avg_rtf', 3)}, 'x') AS rtf, CASE WHEN cost_per_hour IS NULL THEN 'free' ELSE concat('$', {fixed('cost_per_hour', 2)}) END AS cost, total_tests AS tests,
 CASE WHEN s THEN skip_count END AS skips, error_count AS errors, CASE rank WHEN 1 THEN 'green' WHEN 2 THEN 'blue' WHEN 3 THEN 'yellow' ELSE 'plain' END AS tint FROM r CROSS JOIN f""")
def leaderboard(spark, sf_dir):
    return views.leaderboard(rank_global(spark, sf_dir))


@query(f"""SELECT rank, concat(lpad(CAST(rank AS STRING), 4, ' '), '  ', rpad(concat(provider_id, '/', model), 30, ' '), ' ', lpad({fixed('avg_wer * 100', 1)}, 8, ' '), '% ', lpad({fixed('avg_cer * 100', 1)}, 6, ' '),
 '% ', lpad({fixed('avg_rtf', 3)}, 8, ' '), ' ', CASE WHEN cost_per_hour IS NULL THEN '   free' ELSE concat('$', lpad({fixed('cost_per_hour', 2)}, 6, ' ')) END) AS line FROM ({GLOBAL})""")
def console_table(spark, sf_dir):
    return views.console_table(rank_global(spark, sf_dir))


@query(f"{DIM_BASE} SELECT suite_id, coalesce(nullif(name, ''), suite_id) AS title, coalesce(nullif(description, ''), 'Rankings for the selected suite.') AS description FROM (SELECT suite_id, name, description FROM dim UNION ALL SELECT suite_id, name, description FROM existing)")
def view_headings(spark, sf_dir):
    cols = ("suite_id", "name", "description")
    return views.headings(_dim(spark, sf_dir).select(*cols).union(existing_suites(spark).select(*cols)))


# --- work lists ---------------------------------------------------------------------------------------------------

LANGUAGES_SQL = "CASE m16 % 4 WHEN 1 THEN ['de', 'en'] WHEN 2 THEN ['en'] END"
KEY_SQL = "substring(sha1(concat_ws(':', suite_id, test_id, provider_id, model, CAST(run AS STRING))), 1, 16)"
WORK_BASE = f"""WITH tests AS ({TESTS_SQL}), models AS (SELECT provider_id, model, supports_auto, {LANGUAGES_SQL} AS languages FROM ({MODELS_SQL})),
w AS (SELECT *, {KEY_SQL} AS cache_key FROM tests CROSS JOIN models CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS run)),
cache AS MATERIALIZED (SELECT DISTINCT cache_key FROM (SELECT {KEY_SQL} AS cache_key, error FROM ({CACHED_SQL})) WHERE coalesce(error, '') = '')"""
WORK_COLS = "suite_id, test_id, provider_id, model, run, cache_key"
SUPPORT_SQL = "CASE WHEN languages IS NULL THEN true WHEN language = 'auto' THEN supports_auto ELSE list_contains(languages, language) END"


def _work(spark, sf_dir) -> DataFrame:
    return worklist.work_list(spread(tests(spark, sf_dir)), models(spark, sf_dir))  # a test becomes a row for each model and run: not in the few tasks that read the file


def _cache(spark, sf_dir) -> DataFrame:
    return cached(spark, sf_dir).select(worklist.cache_key().alias("cache_key"), "error")


def _listed(work: DataFrame) -> DataFrame:
    return work.select(*WORK_COLS.split(", "))


@query(f"{WORK_BASE} SELECT {WORK_COLS} FROM w")
def work_list(spark, sf_dir):
    return _listed(_work(spark, sf_dir))


@query(f"{WORK_BASE} SELECT {WORK_COLS} FROM w SEMI JOIN cache USING (cache_key)")
def cache_hits(spark, sf_dir):
    return _listed(worklist.cache_hits(_work(spark, sf_dir), _cache(spark, sf_dir)))


@query(f"{WORK_BASE} SELECT {WORK_COLS} FROM w ANTI JOIN cache USING (cache_key)")
def cache_misses(spark, sf_dir):
    return _listed(worklist.cache_misses(_work(spark, sf_dir), _cache(spark, sf_dir)))


@query(f"WITH w AS (SELECT DISTINCT suite_id, test_id, provider_id, model, run FROM ({FACTS_SQL})) SELECT *, {KEY_SQL} AS cache_key FROM w")
def cache_keys(spark, sf_dir):
    return facts(spark, sf_dir).select(*worklist.KEY).distinct().withColumn("cache_key", worklist.cache_key())


@query(f"{WORK_BASE} SELECT provider_id, model, language, count(*) FILTER (WHERE NOT {SUPPORT_SQL}) AS skipped, count(*) AS planned FROM w GROUP BY provider_id, model, language")
def language_skips(spark, sf_dir):
    w = worklist.with_support(_work(spark, sf_dir))
    return w.groupBy("provider_id", "model", "language").agg(F.count_if(~F.col("supported")).alias("skipped"), F.count("*").alias("planned"))


@query(f"{WORK_BASE} SELECT provider_id, model, count(*) AS models FROM models WHERE provider_id IN (SELECT concat('prov', CAST(s_suppkey % 6 AS STRING)) FROM supplier GROUP BY s_suppkey % 6 HAVING max(s_acctbal) > 0 AND min(s_suppkey % 6) <> 4) GROUP BY provider_id, model")
def available_models(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 6).alias("k")).agg(F.max("s_acctbal").alias("most"))
    can = s.select(F.concat(F.lit("prov"), "k").alias("provider_id"), ((F.col("most") > 0) & (F.col("k") != 4)).alias("available"))
    return worklist.available(models(spark, sf_dir), can).groupBy("provider_id", "model").agg(F.count("*").alias("models"))


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, concat('prov', CAST(l_suppkey % 6 AS STRING)) AS provider_id, concat('model', CAST(l_suppkey % 16 AS STRING)) AS model, concat('t-', CAST(l_partkey AS STRING)) AS test_id,
 CASE WHEN l_linenumber = 7 THEN 'skip' WHEN l_discount >= 0.09 THEN 'error' ELSE 'done' END AS type, l_extendedprice AS d, l_tax AS w FROM lineitem)
SELECT 'plan' AS type, CAST(NULL AS STRING) AS provider_id, CAST(NULL AS STRING) AS model, CAST(NULL AS STRING) AS test_id, CAST(NULL AS STRING) AS message, CAST(NULL AS DOUBLE) AS duration_ms, CAST(NULL AS DOUBLE) AS wer_normalized, (SELECT count(*) FROM part) AS total_tests
UNION ALL SELECT 'start', provider_id, model, test_id, NULL, NULL, NULL, NULL FROM o WHERE type <> 'skip'
UNION ALL SELECT type, provider_id, model, test_id, CASE type WHEN 'skip' THEN 'language not supported' WHEN 'error' THEN 'Timeout' END, CASE WHEN type = 'done' THEN d END, CASE WHEN type = 'done' THEN w END, NULL FROM o""")
def run_events(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    o = d.select(
        F.concat(F.lit("prov"), F.col("l_suppkey") % 6).alias("provider_id"), F.concat(F.lit("model"), F.col("l_suppkey") % 16).alias("model"), F.concat(F.lit("t-"), "l_partkey").alias("test_id"),
        (F.col("l_linenumber") != 7).alias("supported"), F.when(F.col("l_discount") >= 0.09, "Timeout").alias("failure"), F.col("l_tax").alias("wer_normalized"), F.col("l_extendedprice").alias("duration_ms"),
    )
    return worklist.events(worklist.classify(o), tests(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber, l_quantity / 60 * CASE l_suppkey % 4 WHEN 0 THEN 0.006::DOUBLE WHEN 1 THEN 0.0043::DOUBLE WHEN 2 THEN 0.0028::DOUBLE ELSE 0::DOUBLE END AS cost_usd,
 CASE WHEN l_quantity - 10 > 0 THEN l_extendedprice / ((l_quantity - 10) * 1000) ELSE 0 END AS realtime_factor FROM lineitem""")
def cost_rtf(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    kind = F.col("l_suppkey") % 4
    provider = F.when(kind == 0, "openai").when(kind == 1, "deepgram").when(kind == 2, "groq").otherwise("whisper-cpp")
    model = F.when(kind == 0, "whisper-1").when(kind == 1, "nova-3").otherwise("whisper-large-v3")
    price = worklist.price_per_minute(provider, model)
    return d.select("l_orderkey", "l_linenumber", worklist.cost(F.col("l_quantity"), price).alias("cost_usd"), worklist.realtime_factor(F.col("l_extendedprice"), F.col("l_quantity") - 10).alias("realtime_factor"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'skipped' WHEN l_discount >= 0.09 THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN l_linenumber <> 7 AND l_discount >= 0.09 THEN 'Timeout' END AS error, CASE WHEN l_linenumber = 7 THEN 'language not supported' END AS skip_reason,
 CASE WHEN l_linenumber = 7 THEN 0 WHEN l_discount >= 0.09 THEN 1 ELSE l_tax END AS wer_normalized, CASE WHEN l_linenumber = 7 OR l_discount >= 0.09 THEN 0 ELSE l_extendedprice END AS duration_ms FROM lineitem""")
def status_classify(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    o = d.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") != 7).alias("supported"), F.when(F.col("l_discount") >= 0.09, "Timeout").alias("failure"), F.col("l_tax").alias("wer_normalized"), F.col("l_extendedprice").alias("duration_ms"))
    return worklist.classify(o)


# --- merging ------------------------------------------------------------------------------------------------------

BATCHES = f"""WITH old AS (SELECT * FROM ({FACTS_SQL}) WHERE l_linenumber <= 3), new AS (SELECT * FROM ({FACTS_SQL}) WHERE l_linenumber > 3 AND starts_with(suite_id, 'hard-'))"""
MERGED = "suite_id, provider_id, model, test_id, run, status, l_orderkey, l_linenumber"


def _batches(spark, sf_dir):
    f = facts(spark, sf_dir).select(*MERGED.split(", "))
    return f.where("l_linenumber <= 3"), f.where("l_linenumber > 3 AND startswith(suite_id, 'hard-')")


@query(f"{BATCHES} SELECT {MERGED} FROM old UNION ALL SELECT {MERGED} FROM new")
def merge_union(spark, sf_dir):
    return merge.merge_union(*_batches(spark, sf_dir))


@query(f"""{BATCHES} SELECT {MERGED} FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.suite_id = old.suite_id AND new.provider_id = old.provider_id AND new.model = old.model)
UNION ALL SELECT {MERGED} FROM new""")
def upsert_by_suite(spark, sf_dir):
    return merge.upsert_by_suite(*_batches(spark, sf_dir))


# --- curation -----------------------------------------------------------------------------------------------------

READ_SQL = "SELECT concat('clip', CAST(doc_id AS STRING)) AS path, text AS sentence, source AS client_id, doc_id % 5 AS up_votes, doc_id % 3 AS down_votes FROM documents"
ROUND_ROBIN = "SELECT {cols}, pick, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {order}) AS pick FROM ({src})) ORDER BY pick, bucket LIMIT {n}"
SAMPLE = 25


@query(f"WITH d AS ({READ_SQL}) " + ROUND_ROBIN.format(cols="path, sentence, up_votes, down_votes", order="up_votes DESC, down_votes, length(sentence), path", src="SELECT *, client_id AS bucket FROM d WHERE length(sentence) BETWEEN 25 AND 180", n=SAMPLE))
def curate_read(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("clip"), F.col("doc_id")).alias("path"), F.col("text").alias("sentence"), F.col("source").alias("client_id"), (F.col("doc_id") % 5).alias("up_votes"), (F.col("doc_id") % 3).alias("down_votes"))
    s = curate.sample_round_robin(curate.readable(d), F.col("client_id"), curate.read_order(), SAMPLE)
    return s.select("path", "sentence", "up_votes", "down_votes", "pick", "bucket")


@query(
    "WITH d AS (SELECT concat('a', CAST(e.event_id AS STRING)) AS audio_file, concat('utterance ', event_type, CAST(user_id AS STRING)) AS transcription, value * 1000 AS duration_ms, user_id % 4 - 1 AS votes, event_type AS prompt FROM events e) "
    + ROUND_ROBIN.format(cols="audio_file, votes, round(duration_ms, 6) AS duration_ms", order="votes DESC, duration_ms, audio_file", src="SELECT *, coalesce(nullif(prompt, ''), audio_file) AS bucket FROM d WHERE votes >= 0 AND length(transcription) > 10 AND duration_ms BETWEEN 3000 AND 30000", n=SAMPLE)
)
def curate_spontaneous(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.select(F.concat(F.lit("a"), F.col("event_id")).alias("audio_file"), F.concat(F.lit("utterance "), "event_type", F.col("user_id").cast("string")).alias("transcription"), (F.col("value") * 1000).alias("duration_ms"), (F.col("user_id") % 4 - 1).alias("votes"), F.col("event_type").alias("prompt"))
    s = curate.sample_round_robin(curate.spontaneous(d), F.coalesce(F.nullif("prompt", F.lit("")), "audio_file"), curate.spontaneous_order(), SAMPLE)
    return s.select("audio_file", "votes", F.round("duration_ms", 6).alias("duration_ms"), "pick", "bucket")


@query(
    "WITH d AS (SELECT doc_id AS id, text AS ground_truth, source AS speaker_id, doc_id * 7 % 100 AS duration_seconds, lang AS split FROM documents) "
    + ROUND_ROBIN.format(cols="id, split, duration_seconds", order="split, duration_seconds, id", src=r"SELECT *, speaker_id AS bucket FROM d WHERE duration_seconds BETWEEN 30 AND 90 AND len(regexp_split_to_array(ground_truth, '[ \t\n\r\f\x0B]+')) BETWEEN 20 AND 140 AND coalesce(speaker_id, '') <> ''", n=20)
)
def curate_longform(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("ground_truth"), F.col("source").alias("speaker_id"), (F.col("doc_id") * 7 % 100).alias("duration_seconds"), F.col("lang").alias("split"))
    s = curate.sample_round_robin(curate.long_form(d), F.col("speaker_id"), curate.long_form_order(), 20)
    return s.select("id", "split", "duration_seconds", "pick", "bucket")


@query(ROUND_ROBIN.format(cols="c_custkey", order="c_acctbal DESC, c_custkey", src="SELECT *, c_nationkey AS bucket FROM customer", n=100))
def sample_round_robin(spark, sf_dir):
    s = curate.sample_round_robin(table(spark, sf_dir, "customer"), F.col("c_nationkey"), [F.desc("c_acctbal"), F.asc("c_custkey")], 100)
    return s.select("c_custkey", "pick", "bucket")


def cursor_sql(source: str, order: str, buckets: str, target: int, step_first: bool) -> str:
    """Picks of one cursor. ``source``: id, bucket and what ``order`` needs; ``buckets``: how the first turn goes through them."""
    go_on = "idx + 1" if step_first else "CASE WHEN dry THEN idx ELSE idx + 1 END"
    return f"""WITH RECURSIVE src AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {order}) AS nth, row_number() OVER (ORDER BY {order}) AS seen FROM ({source})),
b AS (SELECT bucket, count(*) AS n, min(seen) AS seen FROM src GROUP BY bucket),
w(step, idx, ks, ns, us, bucket, nth) AS (
 SELECT 0, 0::BIGINT, list(bucket ORDER BY {buckets}), list(n ORDER BY {buckets}), list(0::BIGINT ORDER BY {buckets}), NULL::INTEGER, NULL::BIGINT FROM b
 UNION ALL SELECT step + 1, CASE WHEN dry THEN CASE WHEN len(ks) = 1 THEN 0 ELSE {go_on} END % greatest(len(ks) - 1, 1) ELSE idx + 1 END,
  CASE WHEN dry THEN list_concat(ks[:p - 1], ks[p + 1:]) ELSE ks END, CASE WHEN dry THEN list_concat(ns[:p - 1], ns[p + 1:]) ELSE ns END,
  CASE WHEN dry THEN list_concat(us[:p - 1], us[p + 1:]) ELSE list_concat(list_append(us[:p - 1], us[p] + 1), us[p + 1:]) END, ks[p], us[p] + 1
 FROM (SELECT *, us[p] + 1 >= ns[p] AS dry FROM (SELECT *, idx % greatest(len(ks), 1) + 1 AS p FROM w WHERE step < {target} AND len(ks) > 0)))
SELECT id, bucket, step::BIGINT AS pick FROM w JOIN src USING (bucket, nth)"""


@query(cursor_sql("SELECT c_custkey AS id, c_nationkey AS bucket, c_acctbal FROM customer", "c_acctbal DESC, id", "bucket", 150, False))
def sample_round_robin_exact(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("bucket"), "c_acctbal")
    return curate.sample_round_robin_exact(d, F.col("bucket"), [F.desc("c_acctbal"), F.asc("id")], 150).select("id", "bucket", "pick")


@query(cursor_sql("SELECT c_custkey AS id, c_nationkey AS bucket, c_acctbal FROM customer", "c_acctbal DESC, id", "seen", 150, True))
def sample_round_robin_first_seen(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("bucket"), "c_acctbal")
    return curate.sample_round_robin_exact(d, F.col("bucket"), [F.desc("c_acctbal"), F.asc("id")], 150, first_seen=True, step_first=True).select("id", "bucket", "pick")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def topk_ids(spark, sf_dir):
    return curate.top_by_id(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")


@query("SELECT user_id, event_type, round(value, 6) AS value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedupe_ids(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_type", F.round("value", 6).alias("value"), "event_id")
    return curate.dedupe_by_id(d, "user_id", "event_id").select("user_id", "event_type", "value", "event_id")


@query("""WITH d AS (SELECT user_id AS id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'train' ELSE 'test' END AS split, event_id AS ord, 30 + event_id % 90 AS duration_seconds, event_type AS speaker_id FROM events),
one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE split WHEN 'test' THEN 1 ELSE 2 END, ord) = 1)
SELECT id, split, ord, duration_seconds FROM one WHERE duration_seconds BETWEEN 30 AND 90 AND len(string_split(concat(repeat('word ', ord % 160), 'word'), ' ')) BETWEEN 20 AND 140 ORDER BY CASE split WHEN 'test' THEN 1 ELSE 2 END, ord LIMIT 80""")
def corpus_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    least = e.agg(F.min("event_type").alias("least"))
    d = e.join(least).select(
        F.col("user_id").alias("id"), F.when(F.col("event_type") == F.col("least"), "train").otherwise("test").alias("split"), F.col("event_id").alias("ord"),
        (30 + F.col("event_id") % 90).alias("duration_seconds"), F.col("event_type").alias("speaker_id"), F.concat(F.expr("repeat('word ', CAST(event_id % 160 AS INT))"), F.lit("word")).alias("ground_truth"),
    )
    return curate.candidates(d, ("test", "train")).select("id", "split", "ord", "duration_seconds")


@query(f"SELECT status, count(*) AS rows_cached FROM ({FACTS_SQL}) WHERE status IS DISTINCT FROM 'error' GROUP BY status")
def cacheable_rows(spark, sf_dir):
    """What the sink has left of all rows, read back."""
    path = folders.fresh(spark, "cache")
    f = facts(spark, sf_dir).select("suite_id", "test_id", "provider_id", "model", "run", "status")
    sinks.write_cache(f, path)
    return readers.read_cache(spark, path, f.schema).groupBy("status").agg(F.count("*").alias("rows_cached"))


@query("SELECT o_orderpriority AS prompt, substring(concat(o_orderpriority, ' ', CAST(o_orderkey AS STRING)), 1, 6) AS short, concat('cv-de-', CASE WHEN pick < 10 THEN '0' ELSE '' END, CAST(pick AS STRING)) AS test_id FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pick FROM orders)")
def numbered_tests(spark, sf_dir):
    n = curate.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "cv-de", [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return n.select(F.col("o_orderpriority").alias("prompt"), views.short_prompt(F.concat_ws(" ", "o_orderpriority", "o_orderkey"), 6).alias("short"), "test_id")


# --- text ---------------------------------------------------------------------------------------------------------

SPOKEN_SQL = f"SELECT utt, concat('I''m ', CAST(utt * 37 % 1200000 AS STRING), ' rock''n''roll uh, it’s ähm O''clock! ', ref) AS t, lang, ref, hyp FROM ({UTTERANCES_SQL})"


def _spoken(spark, sf_dir) -> DataFrame:
    u = utterances(spark, sf_dir)
    t = F.concat(F.lit("I'm "), (F.col("utt") * 37 % 1200000).cast("string"), F.lit(" rock'n'roll uh, it’s ähm O'clock! "), "ref")
    return u.select("utt", t.alias("t"), "lang", "ref", "hyp")


def _quoted(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


DWS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def number_sql(lang: str, n: str) -> str:
    listed = "|".join(words.german_below_thousand() if lang == "de" else words.english_below_thousand())
    low, high = f"string_split('{listed}', '|')[({n} % 1000) + 1]", f"string_split('{listed}', '|')[({n} // 1000) + 1]"
    if lang == "de":
        return f"CASE WHEN {n} = 0 THEN 'null' WHEN {n} = 1 THEN 'eins' WHEN {n} < 1000 THEN {low} WHEN {n} <= 999999 THEN concat({high}, 'tausend', {low}) END"
    return f"CASE WHEN {n} = 0 THEN 'zero' WHEN {n} < 1000 THEN {low} WHEN {n} % 1000 = 0 AND {n} <= 999999 THEN concat({high}, ' thousand') WHEN {n} <= 999999 THEN concat({high}, ' thousand ', {low}) END"


def normalize_sql(source: str, lang: str) -> str:
    """Adds a column ``norm`` of column t."""
    pieces = "array_to_string(list_transform(range(1, len(s) + 1), lambda i: concat(s[i], coalesce(m[i], ''))), '')"
    keys, values = _quoted(words.CONTRACTIONS), _quoted(words.CONTRACTIONS.values())
    a = f"SELECT *, lower(t) AS t1 FROM ({source})"
    if lang == "en":
        pat = r"\b[a-z]+[''’][a-z]+\b"
        to = f"lambda x: coalesce({values}[list_position({keys}, replace(x, '’', ''''))], x)"
        a = f"SELECT * EXCLUDE (s, m), {pieces} AS t2 FROM (SELECT *, regexp_split_to_array(t1, '{pat}') AS s, list_transform(regexp_extract_all(t1, '{pat}'), {to}) AS m FROM ({a}))"
    else:
        a = f"SELECT *, t1 AS t2 FROM ({a})"
    a = rf"SELECT *, regexp_replace(t2, '[^\p{{L}}\p{{N}}{DWS[1:-1]}]', ' ', 'g') AS t3 FROM ({a})"
    spelled = number_sql(lang, "TRY_CAST(x AS BIGINT)")
    a = rf"SELECT * EXCLUDE (s, m), {pieces} AS t4 FROM (SELECT *, regexp_split_to_array(t3, '\b[0-9]+\b') AS s, list_transform(regexp_extract_all(t3, '\b[0-9]+\b'), lambda x: coalesce({spelled}, x)) AS m FROM ({a}))"
    fillers = _quoted(words.DE_FILLERS if lang == "de" else words.EN_FILLERS)
    return f"SELECT * EXCLUDE (t1, t2, t3, t4), trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(t4, '{DWS}+'), lambda x: NOT list_contains({fillers}, x)), ' '), '{DWS}+', ' ', 'g')) AS norm FROM ({a})"


def _normalized(spark, sf_dir, lang: str) -> DataFrame:
    return _spoken(spark, sf_dir).select("utt", text.normalize_text(F.col("t"), lang).alias("norm"))


@query(f"SELECT utt, norm FROM ({normalize_sql(SPOKEN_SQL, 'en')})")
def normalize_en(spark, sf_dir):
    return _normalized(spark, sf_dir, "en")


@query(f"SELECT utt, norm FROM ({normalize_sql(SPOKEN_SQL, 'de')})")
def normalize_de(spark, sf_dir):
    return _normalized(spark, sf_dir, "de")


@query(f"SELECT utt, norm FROM ({normalize_sql(SPOKEN_SQL, 'auto')})")
def normalize_auto(spark, sf_dir):
    return _normalized(spark, sf_dir, "auto")


BOTH_FILLERS = _quoted(dict.fromkeys((*words.EN_FILLERS, *words.DE_FILLERS)))


def code_sql(t: str) -> str:
    return f"trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array({t}, '{DWS}+'), lambda x: NOT list_contains({BOTH_FILLERS}, lower(x))), ' '), '{DWS}+', ' ', 'g'))"


@query(f"SELECT utt, {code_sql('t')} AS norm FROM ({SPOKEN_SQL})")
def normalize_code(spark, sf_dir):
    return _spoken(spark, sf_dir).select("utt", text.normalize_code(F.col("t")).alias("norm"))


NUMBERS_SQL = "SELECT DISTINCT CAST(o_orderkey * 7 % 1000000 AS BIGINT) AS n FROM orders"


@query(f"SELECT n, {number_sql('en', 'n')} AS words FROM ({NUMBERS_SQL})")
def number_words_en(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7 % 1000000).alias("n")).distinct().withColumn("words", text.number_words_en(F.col("n")))


@query(f"SELECT n, {number_sql('de', 'n')} AS words FROM ({NUMBERS_SQL})")
def number_words_de(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7 % 1000000).alias("n")).distinct().withColumn("words", text.number_words_de(F.col("n")))


def rate_sql(source: str, name: str) -> str:
    """(utt, name): edit distance of lists r and h over the length of r, row by row of the table."""
    return f"""WITH RECURSIVE p AS (SELECT utt, r, h FROM ({source}) WHERE len(r) > 0 AND len(h) > 0),
d(utt, i, row_) AS (SELECT utt, 0, range(0, len(h) + 1) FROM p UNION ALL
 SELECT d.utt, i + 1, list_reduce(list_concat([[i + 1]], list_transform(range(1, len(h) + 1), lambda j: [least(row_[j + 1] + 1, row_[j] + (CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END))])),
  lambda acc, c: list_append(acc, least(acc[len(acc)] + 1, c[1]))) FROM d JOIN p USING (utt) WHERE i < len(r))
SELECT utt, round(least(CAST(row_[-1] AS DOUBLE) / len(r), 1), 6) AS {name} FROM d JOIN p USING (utt) WHERE i = len(r)
UNION ALL SELECT utt, CASE WHEN len(r) = 0 AND len(h) = 0 THEN 0.0 ELSE 1.0 END FROM ({source}) WHERE len(r) = 0 OR len(h) = 0"""


def words_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{DWS}+'), lambda x: x <> '')"


PAIRS = f"SELECT utt, lang, ref, hyp FROM ({UTTERANCES_SQL})"
#: Both sides normalized by the row's language: one run of the normalizer for each language.
NORMALIZED_PAIRS = " UNION ALL ".join(
    f"SELECT utt, norm AS nr, nh FROM ({normalize_sql(f'SELECT utt, ref AS t, nh FROM (SELECT utt, ref, norm AS nh FROM ({inner}))', lang)})"
    for lang, where in (("de", "lang = 'de'"), ("en", "lang = 'en'"), ("auto", "lang IS NULL OR lang NOT IN ('de', 'en')"))
    for inner in [normalize_sql(f"SELECT utt, ref, hyp AS t FROM ({PAIRS}) WHERE {where}", lang)]
)


@query(rate_sql(f"SELECT utt, {words_sql('lower(ref)')} AS r, {words_sql('lower(hyp)')} AS h FROM ({PAIRS})", "wer_raw"))
def wer_raw(spark, sf_dir):
    return utterances(spark, sf_dir).select("utt", F.round(metrics.wer_raw(F.col("ref"), F.col("hyp")), 6).alias("wer_raw"))


@query(rate_sql(f"SELECT utt, {words_sql('nr')} AS r, {words_sql('nh')} AS h FROM ({NORMALIZED_PAIRS})", "wer_normalized"))
def wer_normalized(spark, sf_dir):
    u = utterances(spark, sf_dir)
    n = u.select("utt", text.normalize_by(F.col("ref"), F.col("lang")).alias("r"), text.normalize_by(F.col("hyp"), F.col("lang")).alias("h"))
    return n.select("utt", F.round(metrics.wer(F.col("r"), F.col("h")), 6).alias("wer_normalized"))


#: DuckDB's own distance counts bytes, so the letters beyond ASCII that the tables hold become capitals, which no normalized text has.
BEYOND_ASCII, CAPITALS = "àáâäçèéêëìíîïñòóôöùúûüßœæ", "ABCDEFGHIJKLMNOPQRSTUVWXY"
CER_SQL = f"""SELECT utt, CASE WHEN nr = '' AND nh = '' THEN 0.0 WHEN nr = '' OR nh = '' THEN 1.0
 ELSE least(levenshtein(translate(nr, '{BEYOND_ASCII}', '{CAPITALS}'), translate(nh, '{BEYOND_ASCII}', '{CAPITALS}'))::DOUBLE / length(nr), 1) END AS cer FROM ({NORMALIZED_PAIRS})"""


@query(f"SELECT utt, round(cer, 6) AS cer FROM ({CER_SQL})")
def cer(spark, sf_dir):
    u = utterances(spark, sf_dir)
    n = u.select("utt", text.normalize_by(F.col("ref"), F.col("lang")).alias("r"), text.normalize_by(F.col("hyp"), F.col("lang")).alias("h"))
    return n.select("utt", F.round(metrics.cer(F.col("r"), F.col("h")), 6).alias("cer"))


@query(rate_sql(f"SELECT utt, {words_sql(code_sql('ref'))} AS r, {words_sql(code_sql('hyp'))} AS h FROM ({PAIRS})", "code_wer"))
def code_wer(spark, sf_dir):
    return utterances(spark, sf_dir).select("utt", F.round(metrics.code_wer(F.col("ref"), F.col("hyp")), 6).alias("code_wer"))


#: What else might have been said: every fifth word more, half of it, something else; every sixth utterance also as it was heard.
ALTERNATIVES = {"array_to_string(list_transform(rw, lambda x, i: CASE WHEN i % 5 = 0 THEN concat(x, ' uh also') ELSE x END), ' ')": "true", "array_to_string(rw[1:len(rw) // 2], ' ')": "true", "'quite another text'": "true", "hyp": "utt % 6 = 0"}


def alternatives_sql() -> str:
    """Every reference and alternative as a row of its own, normalized, with its hypothesis."""
    every = " UNION ALL ".join(f"SELECT utt * 8 + {k} AS utt, lang, {a} AS ref, hyp FROM ({UTTERANCES_SQL}) WHERE {where}" for k, (a, where) in enumerate({"ref": "true", **ALTERNATIVES}.items()))
    pairs = NORMALIZED_PAIRS.replace(PAIRS, every)
    rates = rate_sql(f"SELECT utt, {words_sql('nr')} AS r, {words_sql('nh')} AS h FROM ({pairs})", "rate")
    return f"SELECT utt // 8 AS utt, min(rate) AS best_alternative_wer FROM ({rates}) GROUP BY 1"


def _with_alternatives(spark, sf_dir) -> DataFrame:
    u = utterances(spark, sf_dir)
    more = F.array_join(F.transform("rw", lambda x, i: F.when(i % 5 == 4, F.concat(x, F.lit(" uh also"))).otherwise(x)), " ")
    half = F.array_join(F.slice("rw", F.lit(1), F.floor(F.size("rw") / 2).cast("int")), " ")
    heard = F.when(F.col("utt") % 6 == 0, F.array("hyp")).otherwise(F.array().cast("array<string>"))
    return u.withColumn("alternatives", F.concat(F.array(more, half, F.lit("quite another text")), heard))


@query(alternatives_sql())
def best_alternative(spark, sf_dir):
    u = _with_alternatives(spark, sf_dir)
    sides = {"r": text.normalize_by(F.col("ref"), F.col("lang")), "h": text.normalize_by(F.col("hyp"), F.col("lang")), "a": F.transform("alternatives", lambda x: text.normalize_by(x, F.col("lang")))}
    d = u.select("utt", *[c.alias(n) for n, c in sides.items()])
    return d.select("utt", F.round(metrics.best_alternative(F.col("r"), F.col("a"), F.col("h")), 6).alias("best_alternative_wer"))


WORD_SQL = r"(\p{L}[\p{L}\p{N}]*)(\p{P}*)"


@query(f"""SELECT utt, i, lower(w[i]) AS word, m[i] AS marks FROM (SELECT utt, w, m, unnest(range(1, len(w) + 1)) AS i FROM
 (SELECT utt, regexp_extract_all(ref, '{WORD_SQL}', 1) AS w, regexp_extract_all(ref, '{WORD_SQL}', 2) AS m FROM ({PAIRS})))""")
def word_punct_pairs(spark, sf_dir):
    u = utterances(spark, sf_dir).select("utt", F.posexplode(metrics.word_marks(F.col("ref"))).alias("i", "p"))
    return u.select("utt", (F.col("i") + 1).cast("long").alias("i"), "p.word", "p.marks")


FORMATTED = f"""SELECT utt, lang, ref, array_to_string(list_transform(hw, lambda x, i: CASE WHEN i % 5 = 3 THEN lower(x) WHEN i % 4 = 2 THEN regexp_replace(x, '[.,]', '', 'g') ELSE x END), ' ') AS hyp FROM ({UTTERANCES_SQL})"""
#: A cell of the edit table is cost, aligned, equal marks and equal capitals in one number.
COST, ALIGNED, MARKS = 1 << 30, 1 << 20, 1 << 10
ALIGN_SQL = f"""WITH RECURSIVE p0 AS (SELECT utt, regexp_extract_all(ref, '{WORD_SQL}', 1) AS ro, regexp_extract_all(ref, '{WORD_SQL}', 2) AS rm,
  regexp_extract_all(hyp, '{WORD_SQL}', 1) AS ho, regexp_extract_all(hyp, '{WORD_SQL}', 2) AS hm FROM ({FORMATTED})),
p AS (SELECT *, list_transform(ro, lambda x: lower(x)) AS r, list_transform(ho, lambda x: lower(x)) AS h FROM p0),
d(utt, i, row_) AS (SELECT utt, 0, list_transform(range(0, len(h) + 1), lambda x: x::BIGINT * {COST}) FROM p UNION ALL
 SELECT d.utt, i + 1, list_reduce(list_concat([[(i + 1)::BIGINT * {COST}]], list_transform(range(1, len(h) + 1), lambda j: [
   row_[j] + CASE WHEN r[i + 1] = h[j] THEN {ALIGNED} + (CASE WHEN rm[i + 1] <> '' AND rm[i + 1] = hm[j] THEN {MARKS} ELSE 0 END) + (CASE WHEN ro[i + 1][1] = ho[j][1] THEN 1 ELSE 0 END) ELSE {COST} END,
   row_[j + 1] + {COST}])),
  lambda acc, c: list_append(acc, CASE WHEN c[1] // {COST} <= c[2] // {COST} AND c[1] // {COST} <= acc[len(acc)] // {COST} + 1 THEN c[1]
   WHEN c[2] // {COST} <= acc[len(acc)] // {COST} + 1 THEN c[2] ELSE acc[len(acc)] + {COST} END)) FROM d JOIN p USING (utt) WHERE i < len(r)),
e AS (SELECT utt, len(r) AS n, len(list_filter(rm, lambda x: x <> '')) AS marked, row_[-1] % {COST} // {ALIGNED} AS aligned, row_[-1] % {ALIGNED} // {MARKS} AS marks, row_[-1] % {MARKS} AS caps FROM d JOIN p USING (utt) WHERE i = len(r)),
s AS (SELECT utt, CASE WHEN marked = 0 THEN 1.0 ELSE marks::DOUBLE / marked END AS punctuation, CASE WHEN n = 0 THEN 1.0 WHEN aligned = 0 THEN 0.0 ELSE caps::DOUBLE / aligned END AS capitals FROM e)"""


def _scores(spark, sf_dir) -> DataFrame:
    u = utterances(spark, sf_dir)
    said = F.transform("hw", lambda x, i: F.when(i % 5 == 2, F.lower(x)).when(i % 4 == 1, F.regexp_replace(x, "[.,]", "")).otherwise(x))
    return u.select("utt", metrics.alignment(F.col("ref"), F.array_join(said, " ")).alias("s"))


@query(f"{ALIGN_SQL} SELECT utt, round(punctuation, 6) AS punctuation_score FROM s")
def punctuation_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("utt", F.round("s.punctuation_score", 6).alias("punctuation_score"))


@query(f"{ALIGN_SQL} SELECT utt, round(capitals, 6) AS capitalization_score, round(0.5 * punctuation + 0.5 * capitals, 6) AS formatting_score FROM s")
def formatting_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("utt", F.round("s.capitalization_score", 6).alias("capitalization_score"), F.round("s.formatting_score", 6).alias("formatting_score"))


def _exact(rate: str) -> str:
    """A rate's SQL without its rounding."""
    return rate.replace("round(least(CAST(row_[-1] AS DOUBLE) / len(r), 1), 6)", "least(CAST(row_[-1] AS DOUBLE) / len(r), 1)")


SCORED = {
    "wer": _exact(rate_sql(f"SELECT utt, {words_sql('nr')} AS r, {words_sql('nh')} AS h FROM ({NORMALIZED_PAIRS})", "wer")),
    "cer": CER_SQL,
}


def _mean(c: str) -> str:
    return six(f"CAST(sum(CAST({c} AS DECIMAL(38, 9))) AS DOUBLE) / count({c})")


@query(f"""SELECT concat('prov', CAST(utt % 3 AS STRING)) AS provider_id, concat('model', CAST(utt % 4 AS STRING)) AS model, {_mean('wer')} AS avg_wer, {_mean('cer')} AS avg_cer,
 {_mean('punctuation')} AS avg_punctuation, {_mean('0.5 * punctuation + 0.5 * capitals')} AS avg_formatting, count(*) AS total_tests
FROM ({SCORED['wer']}) JOIN ({SCORED['cer']}) USING (utt) JOIN ({ALIGN_SQL.replace(FORMATTED, PAIRS)} SELECT utt, punctuation, capitals FROM s) USING (utt) GROUP BY utt % 3, utt % 4""")
def score_and_rank(spark, sf_dir):
    """Transcripts scored with all metrics, then ranked."""
    u = utterances(spark, sf_dir)
    scored = metrics.score_transcripts(u.select("utt", "lang", "ref", "hyp"), "ref", "hyp", "lang", formatted="ref")
    keys = [F.concat(F.lit("prov"), F.col("utt") % 3).alias("provider_id"), F.concat(F.lit("model"), F.col("utt") % 4).alias("model")]
    r = scored.select(*keys, F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), "wer_normalized", "cer", "punctuation_score", "formatting_score", F.lit(1.0).alias("duration_ms"), F.lit(1.0).alias("audio_duration_ms"), F.lit(0.0).alias("realtime_factor"), F.lit(0.0).alias("cost_usd"))
    return rounded(rankings.rank_models(r).select("provider_id", "model", "avg_wer", "avg_cer", "avg_punctuation", "avg_formatting", "total_tests"))


#: DuckDB's distance counts bytes: what the texts hold beyond ASCII becomes control characters, which they don't hold.
CODE_BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
CONTROLS = "concat(" + ", ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 14 + len(CODE_BEYOND) - 8)]) + ")"
CODE_CER_SQL = f"""SELECT utt, CASE WHEN a = '' AND b = '' THEN 0.0 WHEN a = '' OR b = '' THEN 1.0 ELSE least(levenshtein(translate(a, '{CODE_BEYOND}', {CONTROLS}), translate(b, '{CODE_BEYOND}', {CONTROLS}))::DOUBLE / length(a), 1) END AS code_cer
 FROM (SELECT utt, {code_sql('ref')} AS a, {code_sql('hyp')} AS b FROM ({PAIRS}))"""


@query(f"""SELECT utt, wer_raw, wer_normalized, round(cer, 6) AS cer, code_wer AS code_wer_normalized, round(code_cer, 6) AS code_cer, best_alternative_wer, round(punctuation, 6) AS punctuation_score, round(0.5 * punctuation + 0.5 * capitals, 6) AS formatting_score
FROM ({ORACLE_SQL['wer_raw']}) JOIN ({ORACLE_SQL['wer_normalized']}) USING (utt) JOIN ({CER_SQL}) USING (utt) JOIN ({ORACLE_SQL['code_wer']}) USING (utt) JOIN ({CODE_CER_SQL}) USING (utt)
JOIN ({ORACLE_SQL['best_alternative']}) USING (utt) JOIN ({ALIGN_SQL.replace(FORMATTED, PAIRS)} SELECT utt, punctuation, capitals FROM s) USING (utt)""")
def transcript_scores(spark, sf_dir):
    """All eight metrics of every utterance."""
    u = _with_alternatives(spark, sf_dir).select("utt", "lang", "ref", "hyp", "alternatives")
    s = metrics.score_transcripts(u, "ref", "hyp", "lang", code="ref", alternatives="alternatives", formatted="ref")
    names = ("wer_raw", "wer_normalized", "cer", "code_wer_normalized", "code_cer", "best_alternative_wer", "punctuation_score", "formatting_score")
    return s.select("utt", *[F.round(c, 6).alias(c) for c in names])


# --- SQL alone ----------------------------------------------------------------------------------------------------

#: Run as it is by Spark, whose session has the functions; every table is a view. Both sides are normalized once. Rows are
#: summed by number first: the greatest of texts takes a sort, which then is one of some thousand rows.
SCORED_IN_SQL = """
WITH normalized AS (SELECT lang, utt, normalize_text(ref, lang) AS ref, normalize_text(hyp, lang) AS hyp FROM utterances),
scored AS (SELECT lang, utt % 4 AS model, utt % 1000 AS number, word_error_rate(spaced(ref), spaced(hyp)) AS wer, cer(ref, hyp) AS cer FROM normalized),
numbers AS (SELECT lang, model, number, count(*) AS n, count_if(wer = 0) AS perfect, sum(CAST(wer AS DECIMAL(38, 9))) AS wer, sum(CAST(cer AS DECIMAL(38, 9))) AS cer FROM scored GROUP BY lang, model, number)
SELECT coalesce(lang, 'none') AS lang, model, sum(n) AS n, sum(perfect) AS perfect, CAST(sum(wer) AS DOUBLE) AS wer, CAST(sum(cer) AS DOUBLE) AS cer, max(number_words_de(CAST(number AS BIGINT))) AS last_number
FROM numbers GROUP BY lang, model"""


@query(f"""WITH w AS ({SCORED['wer']}), c AS ({CER_SQL}), n AS (SELECT utt, lang, {number_sql('de', '(utt % 1000)')} AS number FROM ({PAIRS}))
SELECT coalesce(lang, 'none') AS lang, utt % 4 AS model, count(*) AS n, count(*) FILTER (WHERE wer = 0) AS perfect, {six("CAST(sum(CAST(wer AS DECIMAL(38, 9))) AS DOUBLE)")} AS wer, {six("CAST(sum(CAST(cer AS DECIMAL(38, 9))) AS DOUBLE)")} AS cer, max(number) AS last_number
FROM w JOIN c USING (utt) JOIN n USING (utt) GROUP BY lang, utt % 4""")
def sql_functions(spark, sf_dir):
    """Scores by language and model, said in SQL: the session's own functions, no Python."""
    s = spark.newSession()
    sql.register(s)
    utterances(s, sf_dir).select("utt", "lang", "ref", "hyp").createOrReplaceTempView("utterances")
    return rounded(s.sql(SCORED_IN_SQL))


@query(f"""WITH s AS ({ranking_sql('facts', 'suite_id')}), d AS (SELECT * FROM ({DIM_BASE} SELECT * FROM dim))
SELECT tier, language, s.provider_id, s.model, count(*) AS suites, min(rank) AS best_rank, sum(total_tests)::BIGINT AS total_tests FROM s JOIN d USING (suite_id) GROUP BY tier, language, s.provider_id, s.model""")
def sql_table_functions(spark, sf_dir):
    """Rankings read like a table, joined with the suites' table, in SQL."""
    s = spark.newSession()
    sql.register_tables(s, facts(s, sf_dir), _dim(s, sf_dir), providers(s, sf_dir))
    return s.sql("SELECT tier, language, provider_id, model, count(*) AS suites, min(rank) AS best_rank, sum(total_tests) AS total_tests FROM rankings_by_suite() JOIN suite_dimension() USING (suite_id) GROUP BY ALL")


# --- tables that are written and read -----------------------------------------------------------------------------


def _states(spark, sf_dir) -> DataFrame:
    """Two batches' states, each summed by itself and appended to one table."""
    f, path = facts(spark, sf_dir), folders.fresh(spark, "ranking-state")
    for k in (0, 1):
        state.ranking_state(f.where(F.col("l_orderkey") % 2 == k)).write.mode("append").parquet(path)
    return state.merge_states(spark.read.parquet(path))


@query(ranking_sql("facts"))
def state_rank_global(spark, sf_dir):
    return rounded(state.rank_state(_states(spark, sf_dir), providers=providers(spark, sf_dir)))


@query(ranking_sql(WITH_CATEGORY, "category"))
def state_rank_by_category(spark, sf_dir):
    return rounded(state.rank_state(_states(spark, sf_dir), "category", suites=_dim(spark, sf_dir), providers=providers(spark, sf_dir)))


@query(ranking_sql(f"({SLICE_ROWS})", "slice"))
def state_rank_by_slice(spark, sf_dir):
    return rounded(state.rank_state(_states(spark, sf_dir), "slice", providers=providers(spark, sf_dir)))


@query(f"""WITH f AS (SELECT *, l_orderkey % 3 AS batch FROM ({FACTS_SQL})), n AS (SELECT * FROM f WHERE batch = 2),
m AS (SELECT * FROM n UNION ALL SELECT f.* FROM f ANTI JOIN n USING (suite_id, provider_id, model) WHERE f.batch < 2 AND f.l_linenumber < 4)
SELECT provider_id, model, suite_id, count(*) AS n, sum(l_orderkey)::BIGINT AS orders, count(*) FILTER (WHERE status = 'ok') AS ok FROM m GROUP BY ALL""")
def snapshot_upsert(spark, sf_dir):
    """Three upserts into a table of snapshots; the last replaces the suites that its rows have."""
    f = facts(spark, sf_dir).withColumn("batch", F.col("l_orderkey") % 3)
    t = snapshots.SnapshotTable(spark, folders.fresh(spark, "results"))
    t.upsert(f.where("batch < 2 AND l_linenumber < 4"))
    t.upsert(f.where("batch = 2"))
    t.upsert(f.where("batch = 2"))
    return t.read().groupBy("provider_id", "model", "suite_id").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"), F.count_if(F.col("status") == "ok").alias("ok"))


@query(f"{WORK_BASE} SELECT {WORK_COLS} FROM w ANTI JOIN cache USING (cache_key)")
def cache_table_misses(spark, sf_dir):
    """Work that isn't in a bucketed cache which earlier runs have been written to."""
    buckets = buckets_for(cached(spark, sf_dir).count(), 16)
    c = CacheTable(spark, folders.fresh(spark, "cache-table"), "cache_key string, status string, error string", buckets)
    c.write(_cache(spark, sf_dir).withColumn("status", F.when(F.coalesce("error", F.lit("")) == "", "ok").otherwise("error")))
    return _listed(c.misses(_work(spark, sf_dir)))


#: Files are written in so many waves at most, of so many rows or more.
WAVES, WAVE_ROWS = 16, 1_000_000
#: Rows of a result document. A document is one value, parsed by one task, so that a file's rows are written as several.
DOCUMENT_ROWS = 20_000
FILES_SQL = f"SELECT *, l_orderkey % 2 AS chunk, concat(provider_id, '_', model, '-', CAST(l_orderkey % 2 AS STRING)) AS file FROM ({FACTS_SQL})"


@query(f"""WITH facts AS ({FACTS_SQL}), f AS ({FILES_SQL}), g AS (SELECT provider_id, model, {measures()} FROM facts GROUP BY provider_id, model),
t AS (SELECT provider_id, arg_max(CASE length(model) % 2 + chunk WHEN 0 THEN 'local' WHEN 1 THEN 'cloud' ELSE 'system' END, file) AS provider_type FROM f GROUP BY provider_id)
SELECT g.*, t.provider_type, row_number() OVER (ORDER BY round(avg_wer, 6), g.provider_id, model) AS rank, 2::BIGINT AS rejects FROM g JOIN t USING (provider_id)""")
def files_rank(spark, sf_dir):
    """Result documents written, read again with two broken ones among them, and ranked with the types that the last files tell.

    A file is a folder of documents of about ``DOCUMENT_ROWS`` rows, so that documents get more and not longer. JSON takes far more
    room than the table, so files are written in ``WAVES`` waves, in order of their names: a wave's rows are summed and its
    documents deleted before the next is written; the last one's stay."""
    f = facts(spark, sf_dir).withColumn("chunk", F.col("l_orderkey") % 2).withColumn("file", F.concat_ws("-", F.concat_ws("_", "provider_id", "model"), "chunk"))
    camel = {"test_id": "testId", "suite_id": "suiteId", "provider_id": "providerId", "model": "model", "run": "run", "status": "status", "error": "error", "test_source": "testSource", "wer_normalized": "werNormalized", "cer": "cer", "punctuation_score": "punctuationScore",
             "formatting_score": "formattingScore", "duration_ms": "durationMs", "realtime_factor": "realtimeFactor", "audio_duration_ms": "audioDurationMs", "cost_usd": "costUsd"}
    sizes = sorted(tuple(r) for r in f.groupBy("file").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    parts = max(1, -(-total // (max(1, len(sizes)) * DOCUMENT_ROWS)))
    f = f.withColumn("part", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts)))
    waves: dict[int, list[str]] = {}
    before, many = 0, min(WAVES, max(1, -(-total // WAVE_ROWS)))
    for name, n in sizes:
        waves.setdefault(before * many // total, []).append(name)
        before += n
    path, sums, seen = (folders.fresh(spark, label) for label in ("result-files", "ranking-state", "result-files-seen"))
    names = list(waves.values()) or [[]]
    for k, of_wave in enumerate(names):
        docs = _documents(f.where(F.col("file").between(of_wave[0], of_wave[-1])) if of_wave else f, camel)
        last = k + 1 == len(names)
        folder = f"{path}/{k:03d}"
        docs.drop("part").write.partitionBy("file").option("maxRecordsPerFile", 1).text(folder)
        if last:
            whole = _documents(f.where("file = 'prov0_model0-0' AND part = 0"), camel)
            cut_off = F.col("value").substr(F.lit(1), F.length("value") - 1)
            broken = whole.select(F.explode(F.array(F.struct(F.lit("zz-1").alias("file"), cut_off.alias("value")), F.struct(F.lit("zz-2").alias("file"), F.lit("[]").alias("value")))).alias("x")).select("x.*")
            broken.write.mode("append").partitionBy("file").option("maxRecordsPerFile", 1).text(folder)
        files = result_files.read_result_files(spark, folder, "*.txt")
        state.ranking_state(result_files.results_of(files)).write.mode("append").parquet(sums)
        rejects = result_files.rejects_of(files).where("NOT kept").agg(F.count("*").alias("rejects")).select(F.lit(None).cast("string").alias("provider_id"), F.lit(None).cast("string").alias("provider_type"), "rejects")
        types = result_files.provider_types_of(files).select("provider_id", "provider_type", F.lit(0).cast("long").alias("rejects"))
        types.union(rejects).withColumn("wave", F.lit(k)).write.mode("append").parquet(seen)
        if not last:
            folders.Store(spark, folder).delete("")
            folders.let_go(spark)
    seen = spark.read.parquet(seen)
    types = seen.where("provider_id IS NOT NULL").groupBy("provider_id").agg(F.max_by("provider_type", "wave").alias("provider_type"))
    ranked = state.rank_state(state.merge_states(spark.read.parquet(sums)), providers=types)
    return rounded(ranked.join(F.broadcast(seen.agg(F.sum("rejects").alias("rejects")))))


def _documents(f: DataFrame, camel: dict[str, str]) -> DataFrame:
    """(file, part, value): a document for each file and part, its rows by suite. Rows are shuffled once."""
    row = F.struct(*[F.col(c).alias(n) for c, n in camel.items()])
    by = f.groupBy("file", "part").agg(*[F.first(c).alias(c) for c in ("provider_id", "model", "chunk")], F.collect_list(row).alias("rows"))
    suites = F.array_distinct(F.col("rows.suiteId"))
    by_suite = F.map_from_arrays(suites, F.transform(suites, lambda s: F.filter("rows", lambda r: r["suiteId"] == s)))
    kind = F.length("model") % 2 + F.col("chunk")
    ranking = F.struct(F.col("provider_id").alias("providerId"), F.when(kind == 0, "local").when(kind == 1, "cloud").otherwise("system").alias("providerType"))
    return by.select("file", "part", F.to_json(F.struct(ranking.alias("ranking"), by_suite.alias("resultsBySuite"))).alias("value"))
