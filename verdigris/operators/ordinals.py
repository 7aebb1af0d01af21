"""Numbering the rows of a table in order, without bringing them together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written

#: ``monotonically_increasing_id`` has a partition's number above these bits, and a row's place in it below.
PLACE_BITS = 33


def with_ordinal(d: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """``d`` with the place of each row in ``order`` from 1. Rows that tie have different numbers.

    Rows are range-partitioned and sorted, and written once, so that parts and places stay as they are. A part's rows follow
    those of all earlier parts: the driver adds up one count per part.
    """
    place = F.monotonically_increasing_id()
    parts = written(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place), "ordered")
    part = F.shiftright("__place", PLACE_BITS)
    before, at = [], 0
    for r in sorted(parts.groupBy(part.alias("part")).count().collect()):
        before.append((r["part"], at))
        at += r["count"]
    starts = d.sparkSession.createDataFrame(before, "__part long, __before long")
    numbered = parts.withColumn("__part", part).join(F.broadcast(starts), "__part")
    within = F.col("__place") - F.shiftleft(F.col("__part"), PLACE_BITS)
    return numbered.withColumn(name, F.col("__before") + within + 1).drop("__part", "__place", "__before")
