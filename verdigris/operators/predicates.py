"""Row predicates of the result table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slices by test id. A test may be in several. The part must start the id or follow a dash.
SLICES = {"fast-speech": "(^|-)fast-", "numbers-dates": "(^|-)numbers-", "technical-jargon": "(^|-)tech-", "proper-nouns": "(^|-)names-"}


def is_skipped() -> Column:
    return F.col("status").eqNullSafe("skipped")


def is_error() -> Column:
    """An error status, or any error text whatever the status."""
    return F.col("status").eqNullSafe("error") | (F.coalesce(F.col("error"), F.lit("")) != "")


def is_valid() -> Column:
    return ~is_skipped() & ~is_error()


def slices() -> Column:
    """array<string> of the slices a row is in."""
    return F.filter(F.array(*[F.when(F.col("test_id").rlike(p), F.lit(s)) for s, p in SLICES.items()]), lambda x: x.isNotNull())


def supports_language(languages: Column, lang: Column, supports_auto: Column) -> Column:
    return F.when(languages.isNull(), True).when(lang == "auto", supports_auto).otherwise(F.array_contains(languages, lang))
