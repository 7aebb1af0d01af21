"""The transcript cache as a table in buckets of its key, so that looking work up shuffles the work and never the cache."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Store, let_go

KEY = "cache_key"
#: Rows of a bucket for which a new table is laid out: looking up sorts a bucket's rows and its work in a task's memory.
BUCKET_ROWS = 500_000


def buckets_for(rows: int, at_least: int) -> int:
    """Buckets of a new table of so many rows."""
    return max(at_least, -(-rows // BUCKET_ROWS))


class CacheTable:
    """A folder of bucketed Parquet files. It knows its number of buckets; ``buckets`` counts where it is new.

    ``schema``: DDL with cache_key and status; the same whenever the folder is opened.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 200):
        self.spark, root = spark, path.rstrip("/")
        known = [n for n in Store(spark, root).names("") if n.startswith("buckets-")]
        self.buckets = int(known[0].rpartition("-")[2]) if known else buckets
        self.path = f"{root}/buckets-{self.buckets}"
        self.name = "verdigris_cache_" + hashlib.sha1(self.path.encode()).hexdigest()[:16]
        where = self.path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def write(self, results: DataFrame) -> None:
        """Appends good and skipped rows; failed ones are left out, so that they are tried again. A bucket gets one file."""
        columns = self.spark.table(self.name).columns
        good = results.where(~F.col("status").eqNullSafe("error")).select(*columns)
        good.repartition(self.buckets, KEY).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        let_go(self.spark)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def hits(self, work: DataFrame) -> DataFrame:
        return work.join(self.read().select(KEY), KEY, "left_semi")

    def misses(self, work: DataFrame) -> DataFrame:
        return work.join(self.read().select(KEY), KEY, "left_anti")
