"""The suite dimension: from suite files, inferred from result rows, and overlays of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources of recorded public speech, and categories by suite-id prefix.
PUBLIC_SOURCES = ("librispeech", "common-voice", "fleurs", "voxpopuli")
CATEGORY_BY_PREFIX = {
    "clean-speech-": "clean-speech",
    "noisy-environment-": "noisy-environment",
    "accented-speech-": "accented-speech",
    "code-dictation-": "code-dictation",
    "whispered-lowquality-": "low-quality-audio",
    "code-switching-": "code-switching",
    "punctuation-formatting-": "punctuation-formatting",
    "number-formatting-": "number-formatting",
    "long-form-speech-": "long-form-speech",
    "hard-": "technical-jargon",
}
# Display names by category; code-switching and others have their own.
NAME_BY_CATEGORY = {
    "clean-speech": "Clean Speech",
    "noisy-environment": "Noisy Environment",
    "accented-speech": "Accented Speech",
    "code-dictation": "Code Dictation",
    "punctuation-formatting": "Punctuation & Formatting",
    "number-formatting": "Number Formatting",
    "low-quality-audio": "Low Quality Audio",
    "long-form-speech": "Long-form Speech",
}
COLUMNS = ("name", "description", "language", "category", "tier", "origin", "test_count")


def language_label(language: Column) -> Column:
    return F.when(language == "de", "German").when(language == "en", "English").otherwise("Auto")


def infer_category(suite_id: Column) -> Column:
    out = F.lit("clean-speech")
    for prefix, category in reversed(CATEGORY_BY_PREFIX.items()):
        out = F.when(suite_id.startswith(prefix), category).otherwise(out)
    return out


def infer_language(suite_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(suite_id, "-(de|en|auto)$", 1), F.lit("")), F.lit("de"))


def infer_tier(suite_id: Column, category: Column, tier: Column | None = None) -> Column:
    inferred = F.when(suite_id.startswith("hard-") | category.isin("code-dictation", "code-switching"), "diagnostic").otherwise("core")
    return inferred if tier is None else F.coalesce(F.nullif(tier, F.lit("")), inferred)


def infer_name(suite_id: Column, language: Column, category: Column) -> Column:
    label = F.concat(F.lit(" ("), language_label(language), F.lit(")"))
    out = F.when(suite_id.startswith("hard-"), F.concat(F.lit("Hard Cases"), label)).otherwise(suite_id)
    for c, name in NAME_BY_CATEGORY.items():
        out = F.when(category == c, F.concat(F.lit(name), label)).otherwise(out)
    switching = F.when(language == "auto", "Code-Switching (auto-detect)").otherwise("Code-Switching (DE hint)")
    return F.when(category == "code-switching", switching).otherwise(out)


def suites_of_tests(tests: DataFrame) -> DataFrame:
    """The dimension from exploded suite files: suite_id, name, description, language, category, benchmark_tier, source."""
    whole = [F.min(c).alias(c) for c in ("name", "description", "language", "category", "benchmark_tier")]
    n = F.count("test_id")
    public = F.coalesce(F.bool_and(F.col("source").isin(*PUBLIC_SOURCES)), F.lit(False)) & (n > 0)
    g = tests.groupBy("suite_id").agg(*whole, F.when(public, "public").otherwise("synthetic").alias("origin"), n.alias("test_count"))
    return g.withColumn("tier", infer_tier(F.col("suite_id"), F.col("category"), F.col("benchmark_tier"))).select("suite_id", *COLUMNS)


def suites_of_results(results: DataFrame, order: str | None = None) -> DataFrame:
    """The dimension inferred from result rows. Where a suite's rows differ in an attribute, the first by ``order`` counts, or the least without one."""
    first = (lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))) if order else F.min
    known = [first(c).alias(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in ("suite_category", "suite_language")]
    if "test_source" in results.columns:
        origin = [F.count("test_source").alias("n_source"), F.coalesce(F.bool_and(F.col("test_source").isin(*PUBLIC_SOURCES)), F.lit(False)).alias("public")]
    else:
        origin = [F.lit(0).alias("n_source"), F.lit(False).alias("public")]
    g = results.groupBy("suite_id").agg(*known, *origin, F.countDistinct("test_id").alias("test_count"))
    sid = F.col("suite_id")
    g = g.withColumn("category", F.coalesce("suite_category", infer_category(sid))).withColumn("language", F.coalesce("suite_language", infer_language(sid)))
    by_id = sid.startswith("clean-speech-") | sid.startswith("accented-speech-") | (F.col("category") == "long-form-speech")
    public = F.when(F.col("n_source") > 0, F.col("public")).otherwise(by_id)
    return g.select(
        "suite_id", infer_name(sid, F.col("language"), F.col("category")).alias("name"),
        F.concat(F.lit("Legacy suite metadata inferred for "), sid).alias("description"), "language", "category",
        infer_tier(sid, F.col("category")).alias("tier"), F.when(public, "public").otherwise("synthetic").alias("origin"), "test_count",
    )


def overlay(inferred: DataFrame, existing: DataFrame, keep_empty_suites: bool = False, empty_is_missing: bool = False) -> DataFrame:
    """Existing values over inferred ones. Suites without results are dropped unless ``keep_empty_suites``."""
    e = existing.select("suite_id", *[F.col(c).alias(f"e_{c}") for c in COLUMNS])

    def over(c: str) -> Column:
        own = F.col(f"e_{c}")
        if empty_is_missing:
            own = F.nullif(own, F.lit(0 if c == "test_count" else ""))
        return F.coalesce(own, F.col(c)).alias(c)

    return inferred.join(e, "suite_id", "full_outer" if keep_empty_suites else "left").select("suite_id", *map(over, COLUMNS))


def last_writer_wins(metadata: DataFrame, order: str) -> DataFrame:
    """The last whole row of each suite by ``order``."""
    row = F.struct(*[c for c in metadata.columns if c not in ("suite_id", order)])
    return metadata.groupBy("suite_id").agg(F.max_by(row, F.col(order)).alias("r")).select("suite_id", "r.*")
