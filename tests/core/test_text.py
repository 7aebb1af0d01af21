import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.functions import metrics, text, words

CASES = [
    ("en", "it's don't I'm", "it is do not i am"),
    ("en", "she scored 100", "she scored one hundred"),
    ("en", "population of 500000", "population of five hundred thousand"),
    ("de", "es gibt 21 Dinge", "es gibt einundzwanzig dinge"),
    ("de", "er hat 100 Euro", "er hat einhundert euro"),
    ("de", "das kostet 999999", "das kostet neunhundertneunundneunzigtausendneunhundertneunundneunzig"),
    ("en", "I've got 2 cats, uh, and 3 dogs!", "i have got two cats and three dogs"),
    ("de", "ähm also hallo äh welt", "also hallo welt"),
    ("en", "0 errors", "zero errors"),
    ("de", "0 Fehler", "null fehler"),
    ("de", "1 101 1001", "eins einhundertein eintausendein"),
    ("en", "2,400 $3.50 15th", "two four hundred three fifty 15th"),
    ("auto", "don't 7", "don t seven"),
    ("en", "rock’n’roll it’s a b", "rock n roll it is a b"),
    ("en", "1000000 007", "1000000 seven"),
    ("en", "", ""),
    ("en", "ü3 a_b", "üthree a b"),
]


def test_normalize_text(spark):
    for lang in ("en", "de", "auto"):
        own = [c for c in CASES if c[0] == lang]
        d = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(own)], "i int, t string")
        got = {r.i: r.n for r in d.select("i", text.normalize_text(F.col("t"), lang).alias("n")).collect()}
        assert [got[i] for i in range(len(own))] == [c[2] for c in own]


def test_normalize_code(spark):
    d = spark.createDataFrame([("uh getUserName um equals uhm fetchData",), ("Äh, uh, x",)], "t string")
    assert [r[0] for r in d.select(text.normalize_code(F.col("t"))).collect()] == ["getUserName equals fetchData", "Äh, uh, x"]


def english(n):
    if n == 0:
        return "zero"

    def below(k):
        out = [words.EN_SMALL[k // 100 - 1] + " hundred"] if k >= 100 else []
        k %= 100
        if k >= 20:
            out += [words.EN_TENS[k // 10 - 2]] + ([words.EN_SMALL[k % 10 - 1]] if k % 10 else [])
        elif k:
            out.append(words.EN_SMALL[k - 1])
        return " ".join(out)

    return " ".join(filter(None, [f"{below(n // 1000)} thousand" if n >= 1000 else "", below(n % 1000)]))


def test_number_words(spark):
    ns = [0, 1, 19, 20, 21, 99, 100, 101, 115, 999, 1000, 1001, 20000, 123456, 999999]
    d = spark.createDataFrame([(n,) for n in ns], "n long")
    got = {r.n: (r.en, r.de) for r in d.select("n", text.number_words_en(F.col("n")).alias("en"), text.number_words_de(F.col("n")).alias("de")).collect()}
    assert all(got[n][0] == english(n) for n in ns)
    assert got[21][1] == "einundzwanzig" and got[1001][1] == "eintausendein" and got[1][1] == "eins"


def test_rates(spark):
    cases = [("a b c", "a x c", 1 / 3), ("a b c", "a b x c", 1 / 3), ("a b c", "a c", 1 / 3), ("", "", 0), ("", "x", 1), ("x", "", 1), ("a", "b c d", 1)]
    d = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate(cases)], "i int, r string, h string")
    got = {x.i: x for x in d.select("i", metrics.wer(F.col("r"), F.col("h")).alias("w")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert got[i].w == pytest.approx(want)
    c = spark.createDataFrame([("hello", "hallo")], "r string, h string").select(metrics.cer(F.col("r"), F.col("h"))).first()[0]
    assert c == pytest.approx(1 / 5)


def test_wer_equals_edit_distance(spark):
    r = random.Random(1)
    pairs = [(i, " ".join(r.choices("abcdef", k=r.randrange(1, 15))), " ".join(r.choices("abcdef", k=r.randrange(1, 15)))) for i in range(200)]
    d = spark.createDataFrame(pairs, "i int, r string, h string")
    got = {x.i: x.w for x in d.select("i", metrics.wer(F.col("r"), F.col("h")).alias("w")).collect()}
    for i, a, b in pairs:
        assert got[i] == pytest.approx(min(1, metrics.distance(a.split(), b.split()) / len(a.split())))


def backtrace(ref, hyp):
    """Scores by walking a full edit table backwards."""
    pair = lambda t: [(m[1].lower(), m[2], m[1][0]) for m in re.finditer(r"([^\W\d_]\w*)([.,!?;:']*)", t)]
    a, b = pair(ref), pair(hyp)
    cost = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1][0] != b[j - 1][0]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, hits = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1][0] != b[j - 1][0]):
            i, j = i - 1, j - 1
            if a[i][0] == b[j][0]:
                hits.append((i, j))
        elif i and (not j or cost[i][j] == cost[i - 1][j] + 1):
            i -= 1
        else:
            j -= 1
    marked = [x for x in a if x[1]]
    p = sum(a[i][1] != "" and a[i][1] == b[j][1] for i, j in hits) / len(marked) if marked else 1.0
    c = 1.0 if not a else sum(a[i][2] == b[j][2] for i, j in hits) / len(hits) if hits else 0.0
    return p, c, (p + c) / 2


def test_alignment_equals_backtrace():
    r = random.Random(2)
    for _ in range(500):
        say = lambda: " ".join(r.choice(["a", "A", "b", "B", "c", "Cd"]) + r.choice(["", "", ".", ","]) for _ in range(r.randrange(0, 10)))
        x, y = say(), say()
        assert metrics.align_scores(x, y) == pytest.approx(backtrace(x, y)), (x, y)


def test_many_alignments_at_once(monkeypatch):
    """Batches of all lengths, and bands that have to double, give what single tables give."""
    from verdigris.functions import align

    r = random.Random(5)
    pair = lambda t: [{"word": m[1].lower(), "marks": m[2], "first": m[1][0]} for m in re.finditer(r"([^\W\d_]\w*)([.,!?;:']*)", t)]
    say = lambda n: " ".join(r.choice(["a", "A", "b", "B", "c", "Cd", "e"]) + r.choice(["", "", ".", ","]) for _ in range(n))
    texts = [(say(r.choice([0, 1, 3, 9, 40])), say(r.choice([0, 2, 3, 9, 40, 90]))) for _ in range(300)]
    for band in (4, 256):
        monkeypatch.setattr(align, "BANDED", band)
        sides = ([pair(a) for a, _ in texts] + [None], [pair(b) for _, b in texts] + [[]])
        got = align.align(*[pa.array(x, align.WORDS) for x in sides])
        for (a, b), g in zip(texts, got, strict=False):
            assert tuple(g) == pytest.approx(backtrace(a, b)), (a, b)
        assert all(x != x for x in got[-1])


def test_large_vocabularies(spark, monkeypatch):
    monkeypatch.setattr(metrics, "ALPHABET_SIZE", 6)
    r = random.Random(6)
    pairs = [(i, " ".join(r.choices("abcdefghij", k=r.randrange(1, 30))), " ".join(r.choices("abcdefghij", k=r.randrange(1, 30)))) for i in range(60)]
    d = spark.createDataFrame(pairs, "i int, r string, h string")
    got = {x.i: x.w for x in d.select("i", metrics.wer(F.col("r"), F.col("h")).alias("w")).collect()}
    for i, a, b in pairs:
        assert got[i] == pytest.approx(min(1, metrics.distance(a.split(), b.split()) / len(a.split())))


def test_compute_all(spark):
    d = spark.createDataFrame([("I have 3 cats", "I have three cats", "en", "getUserName", ["I own 3 cats"], "I have, 3 cats.")], "r string, h string, l string, c string, a array<string>, f string")
    row = metrics.score_transcripts(d, "r", "h", "l", "c", "a", "f").first()
    assert row.wer_raw > 0 and row.wer_normalized == 0 and row.best_alternative_wer == 0 and row.code_wer_normalized == 1
    assert 0 <= row.punctuation_score < 1
    assert row.code_cer == 1.0
    none = spark.createDataFrame([("a b", "a c", None, "", [], "")], "r string, h string, l string, c string, a array<string>, f string")
    one = metrics.score_transcripts(none, "r", "h", "l", "c", "a", "f").first()
    assert (one.wer_raw, one.code_wer_normalized, one.code_cer, one.best_alternative_wer, one.punctuation_score) == (0.5, None, None, None, None)
    plain = metrics.score_transcripts(none, "r", "h", "l")
    assert plain.columns == [*none.columns, "wer_raw", "wer_normalized", "cer", "code_wer_normalized", "code_cer", "best_alternative_wer", "punctuation_score", "formatting_score"]


def test_code_rates(spark):
    cases = [("getUserName", "getUserName", 0.0, 0.0), ("get_x = 1", "get_y = 1", 1 / 3, 1 / 9), ("uh foo() bar", "foo() bar", 0.0, 0.0), ("ab", "abcdefgh", 1.0, 1.0)]
    d = spark.createDataFrame([(i, c, h) for i, (c, h, *_) in enumerate(cases)], "i int, c string, h string")
    got = {x.i: x for x in d.select("i", metrics.code_wer(F.col("c"), F.col("h")).alias("w"), metrics.code_cer(F.col("c"), F.col("h")).alias("e")).collect()}
    for i, (*_, w, e) in enumerate(cases):
        assert (got[i].w, got[i].e) == (pytest.approx(w), pytest.approx(e))


def test_leading_integers(spark):
    d = spark.createDataFrame([("12 px", 12), (" -7", -7), ("+3.9", 3), ("x1", None), ("", None), (None, None), ("99999999999999999999", None)], "t string, n long")
    assert all(r.n == r.m for r in d.withColumn("m", metrics.parse_int(F.col("t"))).collect())


def test_batched_distances():
    """Sequences around multiples of 64 and alphabets small and large, all in one batch."""
    from verdigris.functions import edit

    r = random.Random(4)
    for alphabet in ("ab", "abcdefgé", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))):
        a, b = ["".join(r.choices(alphabet, k=r.choice([0, 1, 63, 64, 65, 130]))) for _ in range(60)], ["".join(r.choices(alphabet, k=r.choice([0, 1, 63, 64, 65, 130]))) for _ in range(60)]
        b[:20] = [x[:3] + x[4:] for x in a[:20]]
        (x, n_x), (y, n_y) = edit._characters(pa.array(a)), edit._characters(pa.array(b))
        assert edit.distances(x, y, n_x, n_y).tolist() == [metrics.distance(p, q) for p, q in zip(a, b, strict=True)]


def test_short_and_long_pairs_have_the_same_rates(spark, monkeypatch):
    rows = [("a b c", "a x c", ["a x", None]), (None, "x", ["x"]), ("x", None, ["x"]), ("", "", [""]), ("  a  b", "a\tb", ["a b"]), ("a " * 50, "a " * 40, ["b " * 60, "a " * 45])]
    d = spark.createDataFrame(rows, "r string, h string, a array<string>")
    r, h = F.col("r"), F.col("h")

    def rates():
        return [tuple(x) for x in d.select(metrics.wer(r, h), metrics.cer(r, h), metrics.best_alternative(r, F.col("a"), h)).collect()]

    batched = rates()
    monkeypatch.setattr(metrics, "SHORT", -1)
    assert batched == rates()
    plan = d.select(metrics.wer(r, h), metrics.cer(r, h))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_texts_are_split_after_they_are_dealt_out(spark, tmp_path):
    from verdigris.plans.facts import utterances

    rows = [(1, "en", " ".join(map(str, range(31)))), (2, "de", "  \n "), (3, "de", None), (4, None, "one")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    u = utterances(spark, str(tmp_path))
    assert sorted((x.utt, len(x.rw), x.hyp) for x in u.collect()) == [(1_000_000, 30, " ".join(str(i) for i in range(30) if i % 7 != 3)), (1_000_001, 1, "30"), (4_000_000, 1, "one")]
    plan = u._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "split(" not in plan[plan.index("Repartition") :]
