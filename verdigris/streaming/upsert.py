"""Result batches as a stream of files: each is scored into the table once, and a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.sinks import upsert_results


def result_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_upsert(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every micro-batch replaces the suites it holds. Writing a batch twice leaves the same table. A batch is kept while it is
    written, so that its rows are read, and counted by ``live.observed``, once."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                upsert_results(batch, table)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
