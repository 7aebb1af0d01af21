"""Merging result batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

SUITE_OF_MODEL = ("suite_id", "provider_id", "model")


def merge_union(*batches: DataFrame) -> DataFrame:
    """All rows of all batches, equal ones too; a column that a batch lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def upsert_by_suite(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, and of ``old`` the suites that a model has no new rows of."""
    touched = new.select(*SUITE_OF_MODEL).distinct()
    return old.join(touched, list(SUITE_OF_MODEL), "left_anti").unionByName(new, allowMissingColumns=True)
