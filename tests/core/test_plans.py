import json
import os

import pytest

from verdigris.plans import queries
from verdigris.sources import cache, folders

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the tables aren't there")


def test_documents_get_more_and_not_longer(spark, tmp_path, monkeypatch):
    whole = sorted(map(tuple, queries.files_rank(spark, SF).collect()))
    monkeypatch.setattr(queries, "DOCUMENT_ROWS", 10)
    monkeypatch.setattr(folders, "fresh", lambda spark, label: str(tmp_path / label))
    assert sorted(map(tuple, queries.files_rank(spark, SF).collect())) == whole
    longest, rows = 0, 0
    for path in tmp_path.rglob("file=prov*/*.txt"):
        n = sum(len(r) for r in json.loads(path.read_text())["resultsBySuite"].values())
        longest, rows = max(longest, n), rows + n
    assert rows == spark.read.parquet(f"{SF}/lineitem.parquet").count() and longest <= 40


def test_files_are_written_in_waves(spark, tmp_path, monkeypatch):
    """Of all rows only the last wave's lie on disk as documents in the end, and results are the same."""
    whole = sorted(map(tuple, queries.files_rank(spark, SF).collect()))
    monkeypatch.setattr(queries, "WAVES", 4)
    monkeypatch.setattr(queries, "WAVE_ROWS", 100)
    monkeypatch.setattr(folders, "fresh", lambda spark, label: str(tmp_path / label))
    assert sorted(map(tuple, queries.files_rank(spark, SF).collect())) == whole
    rows = sum(len(r) for path in tmp_path.rglob("file=prov*/*.txt") for r in json.loads(path.read_text())["resultsBySuite"].values())
    assert 0 < rows <= spark.read.parquet(f"{SF}/lineitem.parquet").count() // 3


def test_work_is_listed_by_all_cores(spark):
    for query in (queries.work_list, queries.cache_hits, queries.cache_misses, queries.cache_table_misses):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" in plan and "Repartition" in plan[plan.index("Generate explode") :]
    assert queries.work_list(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_cache_tables_get_more_buckets_and_not_larger_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BUCKET_ROWS", 50)
    monkeypatch.setattr(folders, "fresh", lambda spark, label: str(tmp_path / label))
    missed = queries.cache_table_misses(spark, SF).count()
    assert missed == queries.cache_misses(spark, SF).count()
    table, = (tmp_path / "cache-table").iterdir()
    files = list(table.glob("*.parquet"))
    assert max(spark.read.parquet(str(f)).count() for f in files[:4]) < 150 and len(files) > 16
    assert all(".zstd." in f.name for f in files)
