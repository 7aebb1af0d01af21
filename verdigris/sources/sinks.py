"""Sinks: tables as Parquet, documents as JSON through Spark's writers."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rankings import rank_by_category, rank_by_slice, rank_models, rankings_map, slice_rows
from .snapshots import SnapshotTable, read_table


def summary_document(results: DataFrame, suites: DataFrame, providers: DataFrame | None, version: str) -> DataFrame:
    """One row: rankings, rankings by suite, category and slice as maps (all slices there), the suites, and totals."""

    def as_map(ranked: DataFrame, key: str, alias: str) -> DataFrame:
        m = rankings_map(ranked, key)
        if key == "slice":
            empty = F.array().cast(m.schema["rankings"].dataType)
            m = slice_rows(results.sparkSession).join(m, "slice", "left").select("slice", F.coalesce("rankings", empty).alias("rankings"))
        return m.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "rankings")))).alias(alias))

    ranked = rank_models(results, providers=providers)
    one = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in ranked.columns if c != "rank"]))).alias("rankings"), F.count("*").alias("total_models"))
    parts = [
        as_map(rank_models(results, "suite_id", providers=providers), "suite_id", "rankings_by_suite"),
        as_map(rank_by_category(results, suites, providers), "category", "rankings_by_category"),
        as_map(rank_by_slice(results, providers), "slice", "rankings_by_slice"),
        suites.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("suite_id", F.struct(*[c for c in suites.columns if c != "suite_id"]))))).alias("suite_metadata"), F.sum("test_count").alias("total_tests")),
    ]
    for p in parts:
        one = one.join(p)
    return one.withColumn("version", F.lit(version)).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def write_summary(document: DataFrame, out: str, version: str, now: datetime | None = None) -> str:
    """A folder <out>/<version>/summary-<time> with one JSON document."""
    stamp = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H-%M-%S-%f")[:-3] + "Z"
    path = f"{out}/{version}/summary-{stamp}"
    document.coalesce(1).write.json(path)
    return path


def upsert_results(new: DataFrame, path: str) -> int:
    """Into a table of snapshots, which holds either all of ``new`` or nothing of it; the version that has it."""
    return SnapshotTable(new.sparkSession, path).upsert(new)


def write_cache(results: DataFrame, path: str) -> None:
    """Good and skipped rows; failed ones are left out, so that they are tried again."""
    results.where(~F.col("status").eqNullSafe("error")).write.mode("append").parquet(path)


def write_suites(suites: DataFrame, path: str) -> None:
    """A file for each suite, indented, as ``read_suites`` takes them."""
    suites.write.mode("overwrite").option("pretty", True).option("maxRecordsPerFile", 1).json(path)


def write_ndjson(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").json(path)


def write_combined(spark, table: str, suites: DataFrame, out: str, providers: DataFrame | None = None) -> str:
    """The summary of all models' results together."""
    return write_summary(summary_document(read_table(spark, table), suites, providers, "combined"), out, "combined")
