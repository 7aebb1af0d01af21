"""Model rankings at any grain: one aggregation, one shuffle on the grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import SLICES, is_error, is_skipped, is_valid, slices

MODEL = ("provider_id", "model")
MS_PER_HOUR = 3_600_000


#: Sums are of decimals, so that they don't depend on the order of rows.
EXACT = "decimal(38,9)"


#: Averages of valid rows, by metric: its name in a ranking, and what it is without a valid row.
MEANS = {"wer_normalized": ("avg_wer", 1.0), "cer": ("avg_cer", 1.0), "realtime_factor": ("avg_rtf", 0.0), "duration_ms": ("avg_duration_ms", 0.0)}
OPTIONAL = {"semantic_score": "avg_semantic", "punctuation_score": "avg_punctuation", "formatting_score": "avg_formatting"}


def partial_sums(df: DataFrame) -> list[Column]:
    """Counts and exact sums of a group of rows. They add up over groups, and ``finished`` makes a ranking's columns of them."""

    def valid(c: str) -> Column:
        return F.when(is_valid(), F.col(c))

    out = [F.count("*").alias("n"), F.count_if(is_skipped()).alias("n_skipped"), F.count_if(is_error()).alias("n_error"), F.count_if(is_valid()).alias("n_valid")]
    for c in (*MEANS, *OPTIONAL):
        have = c in df.columns
        out += [F.sum(valid(c).cast(EXACT) if have else F.lit(None).cast(EXACT)).alias(f"sum_{c}"), (F.count(valid(c)) if have else F.lit(0).cast("long")).alias(f"n_{c}")]
    return [*out, F.sum(valid("audio_duration_ms").cast(EXACT)).alias("sum_audio"), F.sum(F.coalesce(valid("cost_usd"), F.lit(0.0)).cast(EXACT)).alias("sum_cost")]


def finished() -> list[Column]:
    """A ranking's columns from partial sums."""

    def mean(c: str) -> Column:
        return F.col(f"sum_{c}").cast("double") / F.nullif(F.col(f"n_{c}"), F.lit(0))

    def required(c: str) -> Column:
        name, empty = MEANS[c]
        return F.when(F.col("n_valid") == 0, F.lit(empty)).otherwise(F.coalesce(mean(c), F.lit(0.0))).alias(name)

    audio, tried = F.col("sum_audio").cast("double"), F.col("n") - F.col("n_skipped")
    return [
        required("wer_normalized"), required("cer"), *[mean(c).alias(name) for c, name in OPTIONAL.items()], required("realtime_factor"), required("duration_ms"),
        F.when(audio != 0, F.col("sum_cost").cast("double") / audio * MS_PER_HOUR).alias("cost_per_hour"), F.col("n").alias("total_tests"), F.col("n_error").alias("error_count"),
        F.when(tried > 0, F.col("n_error").cast("double") / tried).otherwise(0.0).alias("error_rate"), F.col("n_skipped").alias("skip_count"),
    ]


def with_provider_type(ranked: DataFrame, providers: DataFrame | None) -> DataFrame:
    """``provider_type`` of each row, "cloud" where unknown. ``providers``: provider_id, provider_type."""
    if providers is None:
        return ranked.withColumn("provider_type", F.lit("cloud"))
    one = providers.groupBy("provider_id").agg(F.max("provider_type").alias("provider_type"))
    return ranked.join(one, "provider_id", "left").withColumn("provider_type", F.coalesce("provider_type", F.lit("cloud")))


def with_rank(ranked: DataFrame, *scope: str) -> DataFrame:
    """Position by word error rate within ``scope``; ties go by provider and model."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.round("avg_wer", 6), *MODEL)).cast("long"))


def rank_models(results: DataFrame, *scope: str, providers: DataFrame | None = None) -> DataFrame:
    """One row per ``scope`` and model. Scope values that are null or empty form no group."""
    for s in scope:
        results = results.where(F.coalesce(F.col(s).cast("string"), F.lit("")) != "")
    return with_rank(with_provider_type(results.groupBy(*scope, *MODEL).agg(*partial_sums(results)).select(*scope, *MODEL, *finished()), providers), *scope)


def rank_by_category(results: DataFrame, suites: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """By the category that the suite table has, which may differ from the row's own."""
    of_suite = suites.select("suite_id", F.col("category").alias("scope_category"))
    return rank_models(results.join(of_suite, "suite_id"), "scope_category", providers=providers).withColumnRenamed("scope_category", "category")


def rank_by_slice(results: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    return rank_models(results.withColumn("slice", F.explode(slices())), "slice", providers=providers)


def rank_grains(results: DataFrame, suites: DataFrame) -> DataFrame:
    """Global, by category and by suite in one pass over grouping sets; ``grain`` tells them apart."""
    r = results.join(suites.select("suite_id", F.col("category")), "suite_id", "left")
    sets = [[F.col(c) for c in MODEL], [F.col("category"), *map(F.col, MODEL)], [F.col("suite_id"), *map(F.col, MODEL)]]
    grouped = r.groupingSets(sets, F.col("category"), F.col("suite_id"), *map(F.col, MODEL)).agg(F.grouping_id().alias("gid"), *partial_sums(r))
    grouped = grouped.select("category", "suite_id", *MODEL, "gid", *finished())
    # bits of category and suite_id, high to low; both set: the global grain
    named = F.when((F.col("gid").bitwiseAND(12)) == 12, "global").when(F.col("gid").bitwiseAND(8) == 0, "category").otherwise("suite")
    return grouped.withColumn("grain", named).drop("gid").where((F.col("grain") != "category") | F.col("category").isNotNull())


def slice_rows(spark) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SLICES], "slice string")


def rankings_map(ranked: DataFrame, key: str) -> DataFrame:
    """key -> array of ranking structs in order of rank."""
    row = F.struct(*[c for c in ("rank", *[c for c in ranked.columns if c not in ("rank", key)])])
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rankings"))


def summary_metadata(suites: DataFrame, rankings: DataFrame) -> DataFrame:
    """Models, tests, and the languages and categories there are."""
    s = suites.agg(F.coalesce(F.sum("test_count"), F.lit(0)).alias("total_tests"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return rankings.agg(F.count("*").alias("total_models")).join(s)


def concurrency(providers: DataFrame, parallel: int = 10) -> DataFrame:
    """1 if every provider runs on this machine."""
    return providers.agg(F.when(F.coalesce(F.bool_and(F.col("provider_type").isin("local", "system")), F.lit(True)), 1).otherwise(parallel).cast("long").alias("concurrency"))
