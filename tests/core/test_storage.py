import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import dims, ordinals, rankings, state
from verdigris.sources import snapshots

from .test_tables import SCHEMA, row


def shown(d):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())


def test_merged_states_equal_one_pass(spark):
    r = random.Random(1)
    rows = [row(test=r.choice(["de-fast-01", "names-tech-2", "x"]), suite=r.choice(["hard-de", "clean-speech-en"]), model=r.choice("ab"), status=r.choice(["ok", "skipped", "error"]), error=r.choice([None, None, "late"]), wer=r.random(), audio=r.choice([0.0, 2000.0]), cost=r.choice([None, 0.01])) for _ in range(120)]
    d = spark.createDataFrame(rows, SCHEMA)
    parts = [state.ranking_state(spark.createDataFrame(rows[i::3], SCHEMA)) for i in range(3)]
    merged = state.merge_states(state.merge_states(parts[2], parts[0]), parts[1])
    suites = dims.suites_of_results(d)
    for scope, want in (((), rankings.rank_models(d)), (("suite_id",), rankings.rank_models(d, "suite_id")), (("slice",), rankings.rank_by_slice(d)), (("category",), rankings.rank_by_category(d, suites))):
        got = state.rank_state(merged, *scope, suites=suites)
        assert shown(got.select(*want.columns)) == shown(want)
    assert state.rank_state(state.ranking_state(d.limit(0))).count() == 0


def test_snapshots(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    names = lambda d: sorted((r.model, r.suite_id, r.test_id) for r in d.collect())
    one = spark.createDataFrame([row(suite="a"), row(suite="b"), row(suite="a", model="o/ther =1")], SCHEMA)
    two = spark.createDataFrame([row(suite="a", test="new")], SCHEMA)
    assert (t.upsert(one), t.upsert(two), t.upsert(two)) == (1, 2, 3)
    want = [("baseline", "a", "new"), ("baseline", "b", "de-fast-01"), ("o/ther =1", "a", "de-fast-01")]
    assert names(t.read()) == names(t.read(2)) == want and names(t.read(1)) == names(one)
    assert t.upsert(two.limit(0)) == 4 and names(t.read()) == want
    wider = two.withColumn("note", F.lit("n")).withColumn("model", F.lit("third"))
    t.upsert(wider)
    assert {r.note for r in t.read().collect()} == {None, "n"}
    assert len(t.vacuum(1)) > 0 and {r.model for r in t.read().collect()} == {"baseline", "o/ther =1", "third"} and t.version() == 5


def test_a_writer_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    one, two = (spark.createDataFrame([row(test=x)], SCHEMA) for x in ("old", "new"))
    t.upsert(one)

    def die(*_):
        raise KeyboardInterrupt

    reading = t.read()
    with monkeypatch.context() as m:
        m.setattr(t.store, "publish", die)  # rows and manifest are written, the swap isn't
        with pytest.raises(KeyboardInterrupt):
            t.upsert(two)
    again = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    assert again.version() == 1 and [r.test_id for r in again.read().collect()] == ["old"]
    assert again.upsert(two) == 2 and [r.test_id for r in again.read().collect()] == ["new"]
    assert [r.test_id for r in reading.collect()] == ["old"]  # planned before the swap
    again.vacuum(1)
    assert len(again.store.names("data")) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (snapshots.SnapshotTable(spark, str(tmp_path / "t")) for _ in range(2))
    publish, raced = a.store.publish, []

    def slower(name, as_):
        if not raced:
            raced.append(b.upsert(spark.createDataFrame([row(model="b")], SCHEMA)))
        return publish(name, as_)

    monkeypatch.setattr(a.store, "publish", slower)
    assert a.upsert(spark.createDataFrame([row(model="a")], SCHEMA)) == 2 and raced == [1]
    assert sorted(r.model for r in a.read().collect()) == ["a", "b"]


def test_ordinals(spark):
    r = random.Random(9)
    rows = [(i, r.randrange(40)) for i in range(500)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "i int, k int").repartition(5)
    got = ordinals.with_ordinal(d, [F.desc("k"), F.asc("i")], "n")
    assert [(x.i, x.k) for x in sorted(got.collect(), key=lambda x: x.n)] == sorted(rows, key=lambda x: (-x[1], x[0]))
    assert sorted(x.n for x in got.collect()) == list(range(1, 501))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    ties = ordinals.with_ordinal(d.withColumn("k", F.lit(1)), [F.col("k")])
    assert sorted(x.ordinal for x in ties.collect()) == list(range(1, 501))
    assert ordinals.with_ordinal(d.limit(0), [F.col("k")]).count() == 0
