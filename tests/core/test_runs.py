import json
import time

from pyspark.sql import functions as F

from verdigris.operators import curate, rankings, views, worklist
from verdigris.sources import readers, result_files, sinks, snapshots
from verdigris.sources.cache import CacheTable
from verdigris.streaming import live
from verdigris.streaming.upsert import result_stream, start_upsert

from .test_tables import SCHEMA, row


def test_result_files(spark, tmp_path):
    one = {"testId": "t", "suiteId": "s", "providerId": "p", "model": "m", "run": 1, "werNormalized": 0.25}
    files = {
        "1.json": {"ranking": {"providerId": "p", "providerType": "local"}, "suiteMetadata": {"s": {"name": "old", "testCount": 9}, "u": {"name": "U"}}, "resultsBySuite": {"s": [one]}},
        "2.json": {"ranking": {"providerId": "p", "providerType": "system"}, "suiteMetadata": {"s": {"name": "new"}}, "resultsBySuite": {"s": [{**one, "model": "n", "werNormalized": 0.5}]}},
        "3.json": {"ranking": {"providerId": "p"}, "resultsBySuite": {}},
        "9.json": {"ranking": {"providerId": "q", "providerType": "cloud"}},
    }
    for name, doc in files.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    (tmp_path / "4.json").write_text(json.dumps(files["2.json"])[:-9])
    (tmp_path / "5.json").write_text(" \n")
    (tmp_path / "6.json").write_text("[1, 2]")
    (tmp_path / "7.json").write_text(json.dumps({"resultsBySuite": {"s": [{**one, "model": "o", "run": "first"}]}}))
    (tmp_path / "8.json").write_text("﻿" + json.dumps({"resultsBySuite": {"s": [{**one, "model": "b"}]}}))
    (tmp_path / "10.txt").write_text("not ours")
    d = result_files.read_result_files(spark, str(tmp_path))
    got = {r.source_file[-6:]: (r.problem, r.kept) for r in result_files.rejects_of(d).collect()}
    assert got == {"4.json": ("not valid JSON", False), "5.json": ("empty file", False), "6.json": ("not an object", False), "7.json": ("a field has another type", True)}
    assert sorted((r.model, r.wer_normalized) for r in result_files.results_of(d).collect()) == [("b", 0.25), ("m", 0.25), ("n", 0.5), ("o", 0.25)]
    types = result_files.provider_types_of(d)
    assert {(r.provider_id, r.provider_type) for r in types.collect()} == {("p", "system"), ("q", "cloud")}
    assert {r.suite_id: (r.name, r.test_count) for r in result_files.suites_of(d).collect()} == {"s": ("new", None), "u": ("U", None)}
    assert {r.provider_type for r in rankings.rank_models(result_files.results_of(d), providers=types).collect()} == {"system"}


def test_cache_table(spark, tmp_path):
    schema, path = "cache_key string, status string", str(tmp_path / "c")
    c = CacheTable(spark, path, schema, 4)
    rows = spark.createDataFrame([(f"k{i}", s) for i in range(60) for s in (("ok", "error", "skipped")[i % 3],)], schema)
    c.write(rows.where("cache_key < 'k3'"))
    c.write(rows.where("cache_key >= 'k3'"))
    again = CacheTable(spark.newSession(), path, schema, 99)  # its buckets are the folder's
    assert again.buckets == 4 and again.read().count() == 40
    work = spark.range(80).select(F.concat(F.lit("k"), "id").alias("cache_key"))
    assert {r[0] for r in c.misses(work).collect()} == {f"k{i}" for i in range(80) if i >= 60 or i % 3 == 1}
    assert c.hits(work).count() == 40
    s = spark.newSession()
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    s.conf.set("spark.sql.adaptive.enabled", "false")
    lookup = CacheTable(s, path, schema).misses(s.range(80).select(F.concat(F.lit("k"), "id").alias("cache_key")))
    plan = lookup._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_deadlines(spark):
    class Slow:
        made = 0

        def transcribe(self, audio_file, language, provider_id, model):
            if "slow" in audio_file:
                time.sleep(30)
            if "bad" in audio_file:
                raise ValueError("no such codec")
            return audio_file.upper(), 7.0

    names = ["a", "slow", "b", "bad", "c", "d"]
    t = time.time()
    got = worklist.within_deadline(Slow, [(n, "en", "p", "m") for n in names], 0.5, 2)
    assert time.time() - t < 10
    assert got == [("A", 7.0, None), (None, 0.0, "timed out after 0.5 s"), ("B", 7.0, None), (None, 0.0, "no such codec"), ("C", 7.0, None), ("D", 7.0, None)]
    assert worklist.within_deadline(Slow, [], 1, 1) == []
    d = spark.createDataFrame([(n, "en", "p", "m") for n in names], "audio_file string, language string, provider_id string, model string").coalesce(1)
    out = worklist.classify(worklist.transcribe(d, Slow, seconds=1.0, threads=3).withColumn("supported", F.lit(True)).withColumn("wer_normalized", F.lit(0.5)))
    assert {r.audio_file: (r.status, r.wer_normalized) for r in out.collect()} == {n: ("error", 1.0) if n in ("slow", "bad") else ("ok", 0.5) for n in names}


def test_live_events(spark, tmp_path):
    src, table, said = (str(tmp_path / n) for n in ("src", "table", "said"))
    batches = [[row(test="1"), row(test="2", status="error", error="late"), row(test="3", status="skipped")], [row(test="4", suite="b", wer=0.5)]]
    spark.createDataFrame(batches[0], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    listener = live.LiveEvents(spark, said)
    spark.streams.addListener(listener)
    stream = live.observed(result_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, 1))
    q = start_upsert(stream, table, str(tmp_path / "ck"), available_now=False)
    try:
        for n in (1, 2):
            end = time.time() + 90
            while live.read_live(spark, said).count() < n and time.time() < end:
                time.sleep(0.3)
            assert q.isActive and live.read_live(spark, said).count() == n  # while the stream runs
            if n == 1:
                spark.createDataFrame(batches[1], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = [(r.planned, r.started, r.done, r.skipped, r.failed, r.wer) for r in live.read_live(spark, said).orderBy("batch").collect()]
        assert got == [(3, 2, 1, 1, 1, 0.0), (1, 1, 1, 0, 0, 0.5)]
        assert snapshots.read_table(spark, table).count() == 4
    finally:
        q.stop()
        spark.streams.removeListener(listener)


def test_files_that_are_written(spark, tmp_path):
    suites = spark.createDataFrame([("s", "de", [("t1",), ("t2",)]), ("u", "en", [])], "suite_id string, language string, tests array<struct<id: string>>").coalesce(1)
    assert [r.suite_id for r in curate.of_language(suites, "de").collect()] == ["s"] and curate.of_language(suites, None).count() == 2
    assert curate.total_tests(suites).first()[0] == 2 and curate.total_tests(suites.limit(0)).first()[0] == 0
    sinks.write_suites(suites.withColumnRenamed("suite_id", "id"), str(tmp_path / "suites"))
    back = readers.explode_tests(readers.read_suites(spark, str(tmp_path / "suites")))
    assert sorted((r.suite_id, r.test_id or "") for r in back.collect()) == [("s", "t1"), ("s", "t2"), ("u", "")]
    lines = spark.createDataFrame([("1", 3.5), ("2", None)], "id string, durationSeconds double")
    sinks.write_ndjson(lines, str(tmp_path / "n"))
    assert sorted((r.id, r.duration_seconds) for r in readers.read_ndjson(spark, str(tmp_path / "n")).collect()) == [("1", 3.5), ("2", None)]
    table = str(tmp_path / "table")
    sinks.upsert_results(spark.createDataFrame([row(), row(model="other", suite="b")], SCHEMA), table)
    dim = spark.createDataFrame([("hard-de", "technical-jargon", 1), ("b", "clean-speech", 1)], "suite_id string, category string, test_count long")
    out = sinks.write_combined(spark, table, dim, str(tmp_path / "out"))
    doc = spark.read.json(out).first()
    assert doc.version == "combined" and len(doc.rankings) == 2 and doc.total_tests == 2
    old = spark.createDataFrame([(None, 1)], "rankings_by_slice map<string,string>, n int")
    assert views.fill_summary(old).first() == ({}, 1)
    checked = spark.createDataFrame([("a",), ("z",), (None,)], "k string").select(readers.check_values(F.col("k"), ("a", "b")).alias("ok"))
    assert [r.ok for r in checked.collect()] == [True, False, True]
