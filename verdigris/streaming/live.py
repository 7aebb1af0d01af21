"""What a running stream of results reports: counts of each micro-batch, observed as its rows pass and appended to a table.

The counts are Spark's own observed metrics, so rows aren't read again for them. A listener on the driver writes one small
document a batch; a batch that is run again after a failure writes the same document again.
"""

from __future__ import annotations

import json

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.predicates import is_error, is_skipped, is_valid
from ..sources.folders import Store

METRICS = "run_events"
COUNTS = ("planned", "started", "done", "skipped", "failed")
DDL = "run string, batch long, planned long, started long, done long, skipped long, failed long, wer double, at string"


def observed(results: DataFrame) -> DataFrame:
    """``results``, whose rows are counted by what became of them."""
    wer = F.avg(F.when(is_valid(), F.col("wer_normalized"))) if "wer_normalized" in results.columns else F.lit(None).cast("double")
    return results.observe(
        METRICS, F.count(F.lit(1)).alias("planned"), F.count_if(~is_skipped()).alias("started"), F.count_if(is_valid()).alias("done"),
        F.count_if(is_skipped()).alias("skipped"), F.count_if(is_error()).alias("failed"), wer.alias("wer"),
    )


class LiveEvents(StreamingQueryListener):
    """Appends each batch's counts to ``path``: ``spark.streams.addListener(LiveEvents(spark, path))``."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(METRICS)
        if row is None or not row["planned"]:
            return
        said = {"run": str(p.id), "batch": p.batchId, **{c: row[c] for c in (*COUNTS, "wer")}, "at": p.timestamp}
        name = f"{p.id}-{p.batchId:012d}.json"
        if name not in self.store.names(""):
            try:
                self.store.write(name, json.dumps(said) + "\n")
            except CapturedException:  # the batch was reported by a run before this one
                return

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """A row per batch that has been reported."""
    return spark.read.schema(DDL).json(path) if Store(spark, path).names("") else spark.createDataFrame([], DDL)
