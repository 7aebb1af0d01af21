"""A results table of immutable data folders and manifests.

A manifest lists, for each provider and model, the folder that holds its rows now. An upsert writes the touched models'
rows to a new folder, then a new manifest under a temporary name, and renames that to the next number: until the rename
readers see the old table, after it the new one, and nothing that is being read is ever overwritten. The rename fails where
another writer has taken the number; then the upsert is done anew on what that one has left. A writer that dies leaves
folders no manifest names; ``vacuum`` deletes them, and those of manifests older than the last few.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert_by_suite
from .folders import Store

MODEL = ("provider_id", "model")
PART = "__part"
#: How often an upsert starts anew after others were faster.
ATTEMPTS = 20


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def version(self) -> int:
        """The newest manifest's number, 0 without one."""
        return max((int(n[:-5]) for n in self.store.names("manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"parts": {part: folder}, "schema": ...} of a version, the newest unless told."""
        version = self.version() if version is None else version
        return json.loads(self.store.read(f"manifests/{version:020d}.json")) if version else {"parts": {}, "schema": None}

    def _read(self, manifest: dict, parts: list[str] | None = None) -> DataFrame | None:
        from pyspark.sql.types import StructType

        folders = [f"{self.path}/{f}/{PART}={p}" for p, f in sorted(manifest["parts"].items()) if parts is None or p in parts]
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else None
        if schema is None:
            return None
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a model that was written before a column existed has nulls in it."""
        d = self._read(self.manifest(version))
        if d is None:
            raise FileNotFoundError(self.path)
        return d

    def _stage(self, new: DataFrame, before: dict) -> tuple[dict, str]:
        """The manifest after ``new``, whose rows are written."""
        part = F.sha1(F.to_json(F.struct(*MODEL)))
        new = new.withColumn(PART, part)
        touched = [r[0] for r in new.select(PART).distinct().collect()]  # a row per model
        old = self._read(before, touched)
        rows = new.drop(PART) if old is None else upsert_by_suite(old, new.drop(PART))
        rows = rows.select([F.col(f"`{c}`") for c in rows.columns])
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, part).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        schema = rows.schema
        if old is None and before["schema"]:
            schema = self._read(before, []).unionByName(rows.limit(0), allowMissingColumns=True).schema
        return {"parts": before["parts"] | {p: folder for p in touched}, "schema": schema.jsonValue()}, folder

    def upsert(self, new: DataFrame) -> int:
        """Replaces the suites of the models that ``new`` has rows of; the version that has them. Doing so twice changes nothing."""
        for _ in range(ATTEMPTS):
            at = self.version()
            manifest, folder = self._stage(new, self.manifest(at))
            name = f"manifests/.{uuid.uuid4().hex}"
            self.store.write(name, json.dumps(manifest))
            if self.store.publish(name, f"manifests/{at + 1:020d}.json"):
                return at + 1
            self.store.delete(name)
            self.store.delete(folder)
        raise RuntimeError(f"{ATTEMPTS} times another writer was faster: {self.path}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` manifests and the folders that none of those names; not while a writer is at work."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        used = {f for v in kept for f in self.manifest(v)["parts"].values()}
        gone = [f"data/{n}" for n in self.store.names("data") if f"data/{n}" not in used]
        gone += [f"manifests/{n}" for n in self.store.names("manifests") if n not in {f"{v:020d}.json" for v in kept} and not n.endswith(".crc")]
        for name in gone:
            self.store.delete(name)
        return gone


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return SnapshotTable(spark, path).read(version)
