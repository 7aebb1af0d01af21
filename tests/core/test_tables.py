import json
import struct

import pytest
from pyspark.sql import functions as F

from verdigris.operators import curate, dims, merge, predicates, rankings, views, worklist
from verdigris.sources import readers, sinks, snapshots
from verdigris.streaming.upsert import result_stream, start_upsert

SCHEMA = "test_id string, suite_id string, provider_id string, model string, run int, status string, error string, wer_normalized double, cer double, punctuation_score double, formatting_score double, duration_ms double, realtime_factor double, audio_duration_ms double, cost_usd double"


def row(test="de-fast-01", suite="hard-de", provider="mock", model="baseline", status="ok", error=None, wer=0.0, audio=2000.0, cost=None, run=1):
    return (test, suite, provider, model, run, status, error, wer, wer, None, None, 1000.0, 0.5, audio, cost)


def test_slices_do_not_double_count(spark):
    d = spark.createDataFrame([row(wer=0.2), row("de-tech-01", wer=0.4), row("breakfast-1", wer=0.6)], SCHEMA)
    total = rankings.rank_models(d).collect()
    assert len(total) == 1 and total[0].total_tests == 3 and total[0].avg_wer == pytest.approx(0.4)
    by = {r.slice: r for r in rankings.rank_by_slice(d).collect()}
    assert set(by) == {"fast-speech", "technical-jargon"} and by["fast-speech"].avg_wer == pytest.approx(0.2)


def test_ranking_edges(spark):
    rows = [row(model="skips", status="skipped"), row(model="both", status="skipped", error="x"), row(model="both", status="ok", error="x"), row(model="silent", audio=0.0), row(model="free"), row(model="paid", cost=0.01), row(model="b", wer=0.1), row(model="a", wer=0.1)]
    d = spark.createDataFrame(rows, SCHEMA)
    r = {x.model: x for x in rankings.rank_models(d, providers=spark.createDataFrame([("mock", "local")], "provider_id string, provider_type string")).collect()}
    assert (r["skips"].avg_wer, r["skips"].avg_rtf, r["skips"].cost_per_hour, r["skips"].error_rate, r["skips"].skip_count) == (1.0, 0.0, None, 0.0, 1)
    assert r["both"].error_count == 2 and r["both"].error_rate == 2.0
    assert r["silent"].cost_per_hour is None and r["free"].cost_per_hour == 0 and r["paid"].cost_per_hour == pytest.approx(18)
    assert r["a"].rank + 1 == r["b"].rank and r["a"].provider_type == "local"


def test_legacy_metadata(spark):
    d = spark.createDataFrame([row(suite="code-switching-auto", status="skipped")], SCHEMA)
    m = dims.suites_of_results(d).first()
    assert (m.language, m.category, m.tier, m.test_count, m.name) == ("auto", "code-switching", "diagnostic", 1, "Code-Switching (auto-detect)")


def test_views(spark):
    d = spark.createDataFrame([row(suite="clean-speech-de"), row(suite="clean-speech-de", test="x"), row(suite="hard-de")], SCHEMA)
    s = dims.suites_of_results(d)
    assert views.view_rankings(d, s, views.ViewFilters()).first().total_tests == 2
    assert views.visible_tests(s, views.ViewFilters(tier="all")).first()[0] == 3
    assert [tuple(r) for r in views.scope_options(d, s, views.ViewFilters()).collect()] == [("category", 1, "clean-speech", "clean-speech"), ("slice", 1, "fast-speech", "Fast Speech"), ("suite", 1, "clean-speech-de", "Clean Speech (German)")]
    named = spark.createDataFrame([(f"s{i}", n, "x", "core") for i, n in enumerate(("beta", "Alpha", "alpha", "Éclair", "Zeta"))], "suite_id string, name string, category string, tier string")
    assert [r.label for r in views.scope_options(d, named, views.ViewFilters()).where("kind = 'suite'").collect()] == ["alpha", "Alpha", "beta", "Éclair", "Zeta"]
    rates = spark.createDataFrame([("p", "m", 0.0625), ("p", "n", 0.1455), ("p", "o", 0.0005)], "provider_id string, model string, avg_wer double")
    assert [(r.model, r.wer_percent) for r in views.accuracy_chart(rates).collect()] == [("o", 0.1), ("m", 6.3), ("n", 14.5)]
    assert views.collect_results(d, s, views.ViewFilters("slice", "unknown")).count() == 0
    assert views.default_scope_value(["a"], "b") == "a"
    # a cost of nothing is printed; only where there is none to tell, a model is free
    ranked = rankings.rank_models(d)
    assert views.leaderboard(ranked).first().cost == "$0.00"
    none = views.leaderboard(ranked.withColumn("cost_per_hour", F.lit(None).cast("double"))).first()
    assert (none.cost, none.tint, none.punctuation, none.skips) == ("free", "green", None, None)
    line = views.console_table(ranked).first().line
    assert line.startswith("   1  mock/baseline" + " " * 18) and line.endswith("$  0.00")
    assert views.heading(views.ViewFilters("slice", "proper-nouns"))[0] == "Proper Nouns"
    assert views.heading(views.ViewFilters("suite", "x"), "Name", None) == ("Name", "Rankings for the selected suite.")
    assert views.heading(views.ViewFilters())[0] == "Global"


def test_to_fixed(spark):
    rows = [(0.15, "0.1", "0.15"), (0.125, "0.1", "0.13"), (2.5, "2.5", "2.50"), (0.05, "0.1", "0.05"), (1.005, "1.0", "1.00"), (12345.678, "12345.7", "12345.68"), (0.25, "0.3", "0.25")]
    d = spark.createDataFrame(rows, "x double, one string, two string").select("*", views.to_fixed(F.col("x"), 1).alias("a"), views.to_fixed(F.col("x"), 2).alias("b"))
    assert [(r.a, r.b) for r in d.collect()] == [(r[1], r[2]) for r in rows]


def test_walk():
    # one bucket of three: the cursor stays when b runs dry, so c is next, then a
    assert curate.walk([3, 1, 2], 9) == [(0, 1), (1, 1), (2, 1), (0, 2), (2, 2), (0, 3)]
    assert curate.walk([3, 1, 2], 9, step_first=True) == [(0, 1), (1, 1), (0, 2), (2, 1), (0, 3), (2, 2)]
    assert curate.walk([2, 2], 3) == [(0, 1), (1, 1), (0, 2)] and curate.walk([], 3) == []


def test_events_and_availability(spark):
    o = spark.createDataFrame([("p", "m", "t1", "ok", None, None, 5.0, 0.5), ("p", "m", "t2", "skipped", None, "language not supported", 0.0, 0.0), ("p", "m", "t3", "error", "late", None, 0.0, 1.0)], "provider_id string, model string, test_id string, status string, error string, skip_reason string, duration_ms double, wer_normalized double")
    got = sorted(((r.type, r.test_id, r.message, r.duration_ms, r.total_tests) for r in worklist.events(o, o).collect()), key=str)
    want = [("done", "t1", None, 5.0, None), ("error", "t3", "late", None, None), ("plan", None, None, None, 3), ("skip", "t2", "language not supported", None, None), ("start", "t1", None, None, None), ("start", "t3", None, None, None)]
    assert got == sorted(want, key=str)
    models = spark.createDataFrame([("p", "m"), ("q", "n"), ("r", "o")], "provider_id string, model string")
    can = spark.createDataFrame([("p", True), ("q", False), ("p", True)], "provider_id string, available boolean")
    assert [r.provider_id for r in worklist.available(models, can).collect()] == ["p"]


def test_sums_do_not_depend_on_order(spark):
    rows = [row(wer=w) for w in (0.1, 0.2, 0.3, 1e-9, 0.7, 0.1)]
    means = {rankings.rank_models(spark.createDataFrame(r, SCHEMA).coalesce(1)).first().avg_wer for r in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(means) == 1


def test_work_list_cache_and_failures(spark):
    tests = spark.createDataFrame([("s", "t1", "audio/t-1.wav", "auto"), ("s", "t2", "audio/t-2.wav", "en")], "suite_id string, test_id string, audio_file string, language string")
    models = spark.createDataFrame([("p", "m", False, ["en"]), ("q", "n", True, None)], "provider_id string, model string, supports_auto boolean, languages array<string>")
    w = worklist.with_support(worklist.work_list(tests, models, 2))
    assert w.count() == 8 and w.where(~F.col("supported")).count() == 2
    first = w.orderBy("cache_key").limit(2).select("cache_key", F.lit(None).cast("string").alias("error"))
    assert worklist.cache_misses(w, first).count() == 6 and worklist.cache_hits(w, first).count() == 2
    out = worklist.transcribe(w.where("supported"))
    assert {r.transcription for r in out.collect()} == {"t 1", "t 2"}

    class Broken:
        def transcribe(self, audio_file, language, provider_id, model):
            raise TimeoutError("late")

    failed = worklist.transcribe(w.where("supported"), Broken).withColumn("wer_normalized", F.lit(0.5)).withColumn("realtime_factor", F.lit(1.0))
    r = worklist.classify(failed).first()
    assert (r.status, r.error, r.wer_normalized, r.duration_ms) == ("error", "late", 1.0, 0.0)
    with pytest.raises(ValueError):
        worklist.select_models(models, "nobody")
    with pytest.raises(ValueError):
        worklist.select_models(models, None, "m")


def test_round_robin(spark):
    d = spark.createDataFrame([(b, i) for b, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)], "b string, i int")
    got = [(r.bucket, r.i) for r in curate.sample_round_robin(d, F.col("b"), [F.asc("i")], 5).collect()]
    assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1)]
    exact = curate.sample_round_robin_exact(d, F.col("b"), [F.asc("i")], 6).orderBy("pick").collect()
    assert len(exact) == 6 and exact[0].b == "a"


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([row(suite="a"), row(suite="b"), row(suite="a", model="other")], SCHEMA)
    new = spark.createDataFrame([row(suite="a", test="new1"), row(suite="a", test="new2")], SCHEMA)
    got = sorted((r.model, r.suite_id, r.test_id) for r in merge.upsert_by_suite(old, new).collect())
    want = [("baseline", "a", "new1"), ("baseline", "a", "new2"), ("baseline", "b", "de-fast-01"), ("other", "a", "de-fast-01")]
    assert got == want
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    for batch in (old, new, new):
        batch.coalesce(1).write.mode("append").parquet(src)
        start_upsert(result_stream(spark, src, old.schema, 1), table, str(tmp_path / "stream")).awaitTermination()
    assert sorted((r.model, r.suite_id, r.test_id) for r in snapshots.read_table(spark, table).collect()) == want
    sinks.write_cache(spark.createDataFrame([row(), row(status="error")], SCHEMA), str(tmp_path / "cache"))
    assert readers.read_cache(spark, str(tmp_path / "cache"), SCHEMA).count() == 1
    assert readers.read_cache(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_readers(spark, tmp_path):
    suite = {"id": "hard-de", "name": "n", "description": "d", "language": "de", "category": "technical-jargon", "tests": [{"id": "t", "audioFile": "a.wav", "groundTruth": "x", "tags": ["q"], "source": "custom", "metadata": {"snrDb": 5}}]}
    (tmp_path / "suites").mkdir()
    (tmp_path / "suites" / "a.json").write_text(json.dumps(suite, indent=2))
    (tmp_path / "suites" / "b.txt").write_text("no")
    t = readers.explode_tests(readers.read_suites(spark, str(tmp_path / "suites")))
    assert t.first().test_id == "t" and t.first().metadata.snrDb == 5.0
    assert dims.suites_of_tests(t).first().tier == "diagnostic"
    (tmp_path / "r").mkdir()
    doc = {"resultsBySuite": {"s": [{"testId": "t", "suiteId": "s", "providerId": "p", "model": "m", "run": 1, "werNormalized": 0.5}]}, "suiteMetadata": {"s": {"name": "S", "testCount": 1}}}
    (tmp_path / "r" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "r" / "b.json").write_text("{broken")
    assert readers.read_results(spark, str(tmp_path / "r")).first().wer_normalized == 0.5
    assert readers.read_suite_metadata(spark, str(tmp_path / "r")).first().test_count == 1
    (tmp_path / "x.tsv").write_text('path\tsentence\na\t"quoted\nb\n')
    assert [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "x.tsv"), ("path",)).collect()] == [("a", '"quoted'), ("b", "")]
    with pytest.raises(ValueError):
        readers.read_tsv(spark, str(tmp_path / "x.tsv"), ("votes",))
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "deep" / "1.trans.txt").write_text("u-1 hello there\nnospace\nu-2  \n")
    assert [tuple(r) for r in readers.read_transcripts(spark, str(tmp_path / "t")).collect()] == [("u-1", "hello there")]
    (tmp_path / "m.json").write_text(json.dumps({"k": [{"id": "1", "text": "x"}], "e": []}, indent=2))
    assert [(r.suite_key, r.id) for r in readers.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("k", "1")]
    assert readers.read_optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "n.ndjson").write_text('{"id":"1","durationSeconds":3}\n\n{"id":"2"}\n')
    assert readers.read_ndjson(spark, str(tmp_path / "n.ndjson")).count() == 2
    wav = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 32000)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.wav").write_bytes(wav)
    (tmp_path / "a" / "y.wav").write_bytes(b"junk")
    got = {r.file_path[-5:]: (r.sample_rate, r.duration_seconds) for r in readers.probe_audio(spark, str(tmp_path / "a")).collect()}
    assert got == {"x.wav": (8000, 2.0), "y.wav": (16000, 0.0)}


def test_summary_document(spark, tmp_path):
    d = spark.createDataFrame([row(), row(suite="clean-speech-de", test="x")], SCHEMA)
    doc = sinks.summary_document(d, dims.suites_of_results(d), None, "v1")
    r = doc.first()
    assert set(r.rankings_by_slice) == set(predicates.SLICES) and r.rankings_by_slice["proper-nouns"] == [] and r.total_tests == 2
    path = sinks.write_summary(doc, str(tmp_path), "v1")
    assert spark.read.json(path).count() == 1


def test_overlay_and_last_writer(spark):
    d = spark.createDataFrame([row()], SCHEMA)
    cols = "suite_id string, name string, description string, language string, category string, tier string, origin string, test_count long"
    e = spark.createDataFrame([("hard-de", "", None, "de", None, "core", None, None), ("gone", "g", "g", "de", "c", "core", "public", 0)], cols)
    one = dims.overlay(dims.suites_of_results(d), e).collect()
    assert len(one) == 1 and one[0].name == "" and one[0].tier == "core" and one[0].test_count == 1
    both = {r.suite_id: r for r in dims.overlay(dims.suites_of_results(d), e, True, True).collect()}
    assert both["hard-de"].name == "Hard Cases (German)" and both["gone"].test_count is None
    w = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "suite_id string, name string, o int")
    assert dims.last_writer_wins(w, "o").first().name == "b"


def test_filters(spark):
    d = spark.createDataFrame([("p", "x" * 25), ("p", "x" * 24), ("", "x" * 30)], "path string, sentence string")
    assert curate.readable(d).count() == 1
    s = spark.createDataFrame([(0, "x" * 11, 3000), (-1, "x" * 11, 3000), (1, "x" * 10, 3000), (1, "x" * 11, 30001)], "votes int, transcription string, duration_ms int")
    assert curate.spontaneous(s).count() == 1
