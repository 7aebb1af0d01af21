import random
import re

import pytest
from pyspark.sql import functions as F

from verdigris.functions import metrics, sql, text
from verdigris.operators import dims, predicates, rankings, worklist
from verdigris.plans import queries

from .test_tables import SCHEMA, row
from .test_text import CASES


@pytest.fixture(scope="module")
def session(spark):
    s = spark.newSession()
    sql.register(s)
    return s


def test_functions_equal_the_columns(session):
    r = random.Random(3)
    texts = [t for _, t, _ in CASES] + [None, "  ", "uh um Ähm 12 x'y I'm 1,000 o’clock", " ".join(r.choices(["I'm", "7", "uh", "Straße", "3x", "a_b", "£5"], k=40))]
    pairs = [(i, a, texts[(i * 5 + 3) % len(texts)], lang) for i, a in enumerate(texts) for lang in ("en", "de", "auto", None)]
    session.createDataFrame(pairs, "i int, a string, b string, lang string").createOrReplaceTempView("pairs")
    got = session.sql("""SELECT i, lang, normalize_text(a, lang) AS n, normalize_code(a) AS c, wer(a, b) AS w, cer(a, b) AS e, wer_raw(a, b) AS wr, wer_normalized(a, b, lang) AS wn, cer_normalized(a, b, lang) AS cn,
      code_wer(a, b) AS cw, code_cer(a, b) AS ce, leading_int(a) AS li FROM pairs""")
    a, b, lang = F.col("a"), F.col("b"), F.col("lang")
    na, nb = text.normalize_by(a, lang), text.normalize_by(b, lang)
    want = session.table("pairs").select("i", "lang", na.alias("n"), text.normalize_code(a).alias("c"), metrics.wer(a, b).alias("w"), metrics.cer(a, b).alias("e"), metrics.wer_raw(a, b).alias("wr"), metrics.wer(na, nb).alias("wn"), metrics.cer(na, nb).alias("cn"),
                                         metrics.code_wer(a, b).alias("cw"), metrics.code_cer(a, b).alias("ce"), metrics.parse_int(a).alias("li"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_distances_equal_brute_force(session):
    r = random.Random(7)
    pairs = [("", ""), ("", "a"), ("a b c", "a c"), ("a c", "a b c"), ("a  b", "a b"), (" a", "a "), ("a b", "b a"), (None, "a"), ("a", None)]
    for _ in range(400):
        letters = r.choice(["ab ", "abcdé ", "aß語😀  ", "abcdefghij   "])
        a = "".join(r.choices(letters, k=r.choice([1, 5, 30, 90])))
        fewer = " ".join(w for w in a.split(" ") if r.random() > 0.3)  # words left out: no table is filled
        near = "".join(c if r.random() > 0.05 else r.choice(letters) for c in fewer)  # in a band or beyond
        pairs += [(a, fewer), (fewer, a), (a, near), (a, "".join(r.choices(letters, k=30)))]
    session.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").createOrReplaceTempView("pairs_of_texts")
    got = session.sql("SELECT i, text_distance(a, b) AS c, word_distance(words_of(a), words_of(b)) AS w, some_of(split(a, ' '), split(b, ' ')) AS easy FROM pairs_of_texts").collect()
    assert len(got) == len(pairs) and {True, False, None} == {g.easy for g in got}
    for g in got:
        a, b = pairs[g.i]
        none = a is None or b is None
        assert (g.c, g.w) == ((None, None) if none else (metrics.distance(list(a), list(b)), metrics.distance(a.split(), b.split()))), (a, b)


def test_query_normalizes_each_side_once_and_sorts_no_rows(spark):
    plan = queries.sql_functions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = plan[plan.rindex("HashAggregate(") :]
    assert "Sort [" not in rows and "SortAggregate" not in rows
    assert len(re.findall(r"lower\(\w+#\d+\) AS", rows)) == 2


def test_numbers_and_row_functions(session):
    d = session.createDataFrame([(n,) for n in (-1, 0, 1, 21, 100, 999, 1000, 1001, 21_000, 999_999, 1_000_000, None)], "n long")
    d.createOrReplaceTempView("numbers")
    got = session.sql("SELECT n, number_words_en(n) AS en, number_words_de(n) AS de FROM numbers").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in d.select("n", text.number_words_en(F.col("n")), text.number_words_de(F.col("n"))).collect()}
    rows = session.createDataFrame([row(status=s, error=e, suite=x, test=t) for s in ("ok", "skipped", "error", None) for e in (None, "", "x") for x, t in (("hard-de", "de-fast-1"), ("zzz", "names-tech-2"))], SCHEMA)
    rows.createOrReplaceTempView("rows")
    got = session.sql("SELECT is_skipped(status), is_error(status, error), is_valid(status, error), slices_of(test_id), infer_category(suite_id), infer_language(suite_id), price_per_minute('openai', 'whisper-1'), price_per_minute('x', 'y'), cache_key(suite_id, test_id, provider_id, model, run) FROM rows")
    want = rows.select(predicates.is_skipped(), predicates.is_error(), predicates.is_valid(), predicates.slices(), dims.infer_category(F.col("suite_id")), dims.infer_language(F.col("suite_id")), F.lit(0.006), F.lit(0.0), worklist.cache_key())
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_table_functions(session):
    d = session.createDataFrame([row(suite="hard-de", model="a", wer=0.1), row(suite="clean-speech-en", model="b", wer=0.3), row(suite="hard-de", model="b", status="error")], SCHEMA)
    suites = dims.suites_of_results(d)
    assert "rankings" in sql.register_tables(session, d, suites)
    top = session.sql("SELECT provider_id, model, avg_wer, rank FROM rankings() WHERE rank <= 1").collect()
    assert [tuple(r) for r in top] == [("mock", "a", pytest.approx(0.1), 1)]
    assert {(r.suite_id, r.model, r.rank) for r in session.sql("SELECT * FROM rankings_by_suite()").collect()} == {(r.suite_id, r.model, r.rank) for r in rankings.rank_models(d, "suite_id").collect()}
    named = session.sql("SELECT name, count(*) AS n FROM rankings_by_suite() JOIN suite_dimension() USING (suite_id) GROUP BY name")
    assert {r.name: r.n for r in named.collect()} == {"Hard Cases (German)": 2, "Clean Speech (English)": 1} or named.count() == 2
