"""Leaderboard views: filter the small suite table first, then rank what is left of the results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import SLICES
from .rankings import rank_models


@dataclass(frozen=True)
class ViewFilters:
    scope: str = "global"
    scope_value: str = ""
    tier: str = "core"
    language: str = "all"
    origin: str = "all"


def filtered_suites(suites: DataFrame, f: ViewFilters) -> DataFrame:
    """Suites in order of name as people read it."""
    for c in ("tier", "language", "origin"):
        if (v := getattr(f, c)) != "all":
            suites = suites.where(F.col(c) == v)
    return suites.orderBy(F.collate("name", "UNICODE"), "suite_id")


def collect_results(results: DataFrame, suites: DataFrame, f: ViewFilters) -> DataFrame:
    keep = filtered_suites(suites, f)
    if f.scope == "category" and f.scope_value:
        keep = keep.where(F.col("category") == f.scope_value)
    if f.scope == "suite" and f.scope_value:
        results = results.where(F.col("suite_id") == f.scope_value)
    if f.scope == "slice" and f.scope_value:
        results = results.where(F.col("test_id").rlike(SLICES[f.scope_value])) if f.scope_value in SLICES else results.limit(0)
    return results.join(keep.select("suite_id"), "suite_id", "left_semi")


def view_rankings(results: DataFrame, suites: DataFrame, f: ViewFilters, providers: DataFrame | None = None) -> DataFrame:
    return rank_models(collect_results(results, suites, f), providers=providers)


def scope_options(results: DataFrame, suites: DataFrame, f: ViewFilters) -> DataFrame:
    """(kind, ordinal, value, label): the categories, suites and slices that the filters leave, each kind in the order it is shown
    in: categories by code, suites by name as people read it, slices as they are listed."""
    keep = filtered_suites(suites, f)
    category = keep.select(F.lit("category").alias("kind"), F.col("category").alias("value"), F.col("category").alias("label")).distinct()
    own = Window.partitionBy("kind")
    category = category.withColumn("ordinal", F.row_number().over(own.orderBy("value")))
    suite = keep.select(F.lit("suite").alias("kind"), F.col("suite_id").alias("value"), F.col("name").alias("label"))
    suite = suite.withColumn("ordinal", F.row_number().over(own.orderBy(F.collate("label", "UNICODE"), "value")))
    left = results.join(keep.select("suite_id"), "suite_id", "left_semi")
    hit = left.agg(*[F.coalesce(F.bool_or(F.col("test_id").rlike(p)), F.lit(False)).alias(s) for s, p in SLICES.items()])
    listed = F.array(*[F.when(F.col(f"`{s}`"), F.struct(F.lit(s).alias("value"), F.lit(SLICE_TITLES[s]).alias("label"))) for s in SLICES])
    slice_ = hit.select(F.posexplode(F.array_compact(listed)).alias("i", "x")).select(F.lit("slice").alias("kind"), "x.value", "x.label", (F.col("i") + 1).alias("ordinal"))
    return category.unionByName(suite).unionByName(slice_).select("kind", "ordinal", "value", "label").orderBy("kind", "ordinal")


def visible_tests(suites: DataFrame, f: ViewFilters) -> DataFrame:
    """Tests of the filtered suites, whatever the scope."""
    return filtered_suites(suites, f).agg(F.coalesce(F.sum("test_count"), F.lit(0)).cast("long").alias("visible_tests"))


def default_scope_value(options: list[str], current: str) -> str:
    return current if current in options else options[0] if options else ""


def accuracy_chart(rankings: DataFrame) -> DataFrame:
    return rankings.select("provider_id", "model", to_fixed(F.col("avg_wer") * 100, 1).cast("double").alias("wer_percent")).orderBy("wer_percent", "provider_id", "model")


def to_fixed(x: Column, digits: int) -> Column:
    """A number of at least zero with so many decimals, rounded by its exact value, what lies halfway up."""
    halfway = (x * 2 ** (digits + 1)) % 2 == 1  # only multiples of a power of two lie exactly halfway
    return F.call_function("format_number", F.when(halfway, x + 1e-9).otherwise(x), F.lit("0." + "0" * digits))


def speed_chart(rankings: DataFrame) -> DataFrame:
    return rankings.select("provider_id", "model", to_fixed(F.col("avg_rtf"), 3).cast("double").alias("avg_rtf")).orderBy("avg_rtf", "provider_id", "model")


def cost_chart(rankings: DataFrame) -> DataFrame:
    """Costs of an hour; models without a cost or with none are free."""
    cost = F.coalesce(to_fixed(F.col("cost_per_hour"), 2).cast("double"), F.lit(0.0))
    return rankings.select("provider_id", "model", cost.alias("cost"), (F.coalesce("cost_per_hour", F.lit(0.0)) == 0).alias("free")).orderBy(F.coalesce("cost_per_hour", F.lit(0.0)), "provider_id", "model")


def leaderboard_flags(rankings: DataFrame) -> DataFrame:
    """Which optional columns a leaderboard shows."""
    has = lambda c: F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False))
    return rankings.agg(has("avg_punctuation").alias("has_punctuation"), has("avg_formatting").alias("has_formatting"), F.coalesce(F.bool_or(F.col("skip_count") > 0), F.lit(False)).alias("has_skips"))


# How the first three ranks are tinted.
TINTS = {1: "green", 2: "blue", 3: "yellow"}


def _percent(c: str) -> Column:
    return F.concat(to_fixed(F.col(c) * 100, 1), F.lit("%"))


def leaderboard(rankings: DataFrame) -> DataFrame:
    """The web table: percentages, speed and price as printed. Punctuation, formatting and skips are null where no row has any."""
    flags = leaderboard_flags(rankings)
    tint = F.lit("plain")
    for rank, colour in TINTS.items():
        tint = F.when(F.col("rank") == rank, colour).otherwise(tint)
    return rankings.join(F.broadcast(flags)).select(
        "rank", F.concat_ws("/", "provider_id", "model").alias("model"), F.col("provider_type").alias("type"), _percent("avg_wer").alias("wer"), _percent("avg_cer").alias("cer"),
        F.when(F.col("has_punctuation"), F.coalesce(_percent("avg_punctuation"), F.lit("-"))).alias("punctuation"),
        F.when(F.col("has_formatting"), F.coalesce(_percent("avg_formatting"), F.lit("-"))).alias("formatting"),
        F.concat(to_fixed(F.col("avg_rtf"), 3), F.lit("x")).alias("rtf"), F.coalesce(F.concat(F.lit("$"), to_fixed(F.col("cost_per_hour"), 2)), F.lit("free")).alias("cost"),
        F.col("total_tests").alias("tests"), F.when(F.col("has_skips"), F.col("skip_count")).alias("skips"), F.col("error_count").alias("errors"), tint.alias("tint"),
    ).orderBy("rank")


def console_table(rankings: DataFrame) -> DataFrame:
    """(rank, line): the console's table, in columns of fixed width; what is wider isn't cut."""

    def right(c: Column, n: int) -> Column:
        return F.when(F.length(c) < n, F.lpad(c, n, " ")).otherwise(c)

    name = F.concat_ws("/", "provider_id", "model")
    cost = F.coalesce(F.concat(F.lit("$"), right(to_fixed(F.col("cost_per_hour"), 2), 6)), F.lit("   free"))
    parts = [
        right(F.col("rank").cast("string"), 4), F.lit("  "), F.when(F.length(name) < 30, F.rpad(name, 30, " ")).otherwise(name), F.lit(" "),
        right(to_fixed(F.col("avg_wer") * 100, 1), 8), F.lit("% "), right(to_fixed(F.col("avg_cer") * 100, 1), 6), F.lit("% "), right(to_fixed(F.col("avg_rtf"), 3), 8), F.lit(" "), cost,
    ]
    return rankings.select("rank", F.concat(*parts).alias("line")).orderBy("rank")


# Titles of slices, and what a view says about itself.
SLICE_TITLES = {"fast-speech": "Fast Speech", "numbers-dates": "Numbers & Dates", "technical-jargon": "Technical Jargon", "proper-nouns": "Proper Nouns"}
DESCRIPTIONS = {
    "global": "Rankings across all suites matching the active filters.",
    "category": "Rankings aggregated over all suites in the selected category.",
    "suite": "Rankings for the selected suite.",
    "slice": "Diagnostic slice derived from existing test IDs without rerunning clips.",
}


def heading(f: ViewFilters, name: str | None = None, description: str | None = None) -> tuple[str, str]:
    """(title, description) of a view. ``name`` and ``description`` are the suite's own, where the scope is a suite."""
    value, kind = f.scope_value, f.scope if f.scope in DESCRIPTIONS else "global"
    title = {"global": "Global", "category": value or "Category", "suite": name or value or "Suite", "slice": SLICE_TITLES.get(value) or value or "Slice"}[kind]
    return title, (description if kind == "suite" and description else DESCRIPTIONS[kind])


def headings(suites: DataFrame) -> DataFrame:
    """(suite_id, title, description) of every suite's view."""
    title = F.coalesce(F.nullif("name", F.lit("")), F.nullif("suite_id", F.lit("")), F.lit("Suite"))
    return suites.select("suite_id", title.alias("title"), F.coalesce(F.nullif("description", F.lit("")), F.lit(DESCRIPTIONS["suite"])).alias("description"))


def fill_summary(document: DataFrame) -> DataFrame:
    """Members that old documents lack, as empty maps."""
    maps = [c for c, t in document.dtypes if t.startswith("map<")]
    return document.select(*[F.coalesce(F.col(c), F.create_map().cast(document.schema[c].dataType)).alias(c) if c in maps else F.col(c) for c in document.columns])


def short_prompt(prompt, length: int = 60):
    return F.substring(prompt, 1, length)
