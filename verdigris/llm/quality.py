"""Quality rules on the distribution of characters and common words, in SQL functions alone.

Base rules reject documents with few words or with much text inside repeated five-word windows. The others compare
two histograms of a document with the references of its language by Jensen-Shannon distance (base 2, so 0 to 1): one
of character classes, one of the language's common words. References are public text statistics, fixed below, so a
document's verdict depends on that document alone. Short documents have noisy histograms, so each distance has a
minimum length below which it doesn't speak.

Null and empty texts have no words and fail the base rules. A null or unknown language is held against all
references, and the nearest counts. Repeated rows get the same verdict each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: Characters a document needs before its classes are compared, and words before its common words are.
MIN_CHARS = 400
MIN_COMMON_WORDS = 100
#: Distances above these reject.
MAX_CLASS_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.45

#: Share of lower-case letters, upper-case letters, digits, white space, usual punctuation, anything else.
CLASSES = {
    "en": (0.785, 0.020, 0.003, 0.165, 0.025, 0.002),
    "de": (0.785, 0.035, 0.003, 0.150, 0.025, 0.002),
    "fr": (0.785, 0.020, 0.003, 0.165, 0.025, 0.002),
    "es": (0.785, 0.020, 0.003, 0.165, 0.025, 0.002),
}
#: Common words of each language and their usual counts in a thousand words.
COMMON = {
    "en": {"the": 60, "of": 30, "and": 28, "to": 26, "in": 21, "a": 21, "is": 11, "that": 11, "for": 9, "it": 9, "with": 7, "as": 7, "was": 8, "on": 7, "be": 6, "by": 5, "are": 5, "this": 5},
    "de": {"der": 35, "die": 34, "und": 28, "in": 18, "den": 13, "von": 10, "zu": 11, "das": 11, "mit": 9, "sich": 7, "des": 8, "auf": 7, "ist": 9, "nicht": 7, "ein": 8, "eine": 8, "dem": 8, "im": 7},
    "fr": {"de": 50, "la": 30, "le": 25, "et": 25, "les": 21, "des": 18, "en": 14, "un": 13, "du": 12, "une": 12, "que": 10, "est": 10, "dans": 9, "pour": 9, "qui": 9, "par": 7, "au": 7, "sur": 7},
    "es": {"de": 60, "la": 40, "que": 30, "el": 29, "en": 28, "y": 27, "a": 20, "los": 18, "se": 13, "del": 13, "las": 11, "un": 11, "por": 10, "con": 9, "una": 9, "es": 8, "no": 9, "para": 7},
}
#: White space, and in this order lower-case letters, upper-case letters, digits, white space, usual punctuation.
WS = r"[\x09-\x0D\x20]+"
CLASS_PATTERNS = (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", WS, r"""[.,;:!?'"()«»¿¡‘’“”–—-]+""")
NOT_LETTERS = r"[^\p{L}]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often and deep ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of an array of counts from one of shares; zero counts add nothing."""

    def term(p: Column, q: Column) -> Column:
        return let((p + q) / 2, lambda m: (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + q * F.log2(q / m)) / 2)

    def of(c: Column) -> Column:
        n = F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
        return let(n, lambda t: F.aggregate(F.zip_with(c, shares, lambda x, q: term(x / t, q)), F.lit(0.0), lambda x, y: x + y))

    return F.sqrt(F.greatest(F.lit(0.0), let(F.transform(counts, lambda x: x.cast("double")), of)))


def class_shares(k: str) -> tuple[float, ...]:
    return tuple(x / sum(CLASSES[k]) for x in CLASSES[k])


def word_shares(k: str) -> tuple[float, ...]:
    s = [v / 1000 for v in COMMON[k].values()]
    return (*s, 1 - sum(s))


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more. Hashes show which texts have any; those are sorted."""
    n = F.size(words)

    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", *[w[i + k] for k in range(WINDOW)])

    def covered(z: Column) -> Column:
        last = F.size(z) - 1
        same = F.filter(F.sequence(F.lit(0), last), lambda j: (z[j]["k"] == F.get(z, j - 1)["k"]) | (z[j]["k"] == F.get(z, j + 1)["k"]))
        starts = F.array_sort(F.transform(same, lambda j: z[j]["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        return F.aggregate(starts, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])

    def exact(_: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(window(words, i).alias("k"), i.alias("i")))
        return let(F.sort_array(rows), covered)

    def by_hash(h: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))
        return let(all_, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(exact(x)))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), by_hash))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: str | None = None) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, both distances (null where unguarded) and ``kept``.

    ``carry`` names a column that goes along unchanged.
    """
    extra = [F.col(carry).alias("carried")] if carry else []
    go_on = ["carried"] if carry else []
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"), *extra)
    text, lang = F.col("text"), F.col("lang")
    n = F.length(text)
    counts = [n - without(text, p) for p in CLASS_PATTERNS]
    words = F.filter(F.split(text, WS), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    listed = sorted({w for ws in COMMON.values() for w in ws})
    plain = F.filter(F.split(F.lower(text), NOT_LETTERS), lambda x: x != "")
    common = let(plain, lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(listed)).alias("w")))
    d = d.select(
        *go_on, "doc_id", "lang", n.alias("n_chars"),
        let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))).alias("words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        (n - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.array(*counts).alias("classes"), common.alias("common"),
    )

    def of_language(values) -> Column:
        """``values`` of the row's language; null for a null or unknown one."""
        first, *more = CLASSES
        out = F.when(lang == first, literals(values(first)))
        for k in more:
            out = out.when(lang == k, literals(values(k)))
        return out

    def nearest(own, to) -> Column:
        return F.when(lang.isin(list(CLASSES)), own).otherwise(F.least(*[to(k) for k in CLASSES]))

    classes = F.concat(F.col("classes"), F.array(F.col("n_chars") - F.aggregate("classes", F.lit(0), lambda x, y: x + y)))
    class_distance = let(classes, lambda c: nearest(distance(c, of_language(class_shares)), lambda k: distance(c, literals(class_shares(k)))))

    def word_counts(c: Column, listed: Column) -> Column:
        own = F.transform(listed, lambda w: F.size(c["w"]) - F.size(F.array_remove(c["w"], w)))
        return let(own, lambda a: F.concat(a, F.array(c["n"] - F.aggregate(a, F.lit(0), lambda x, y: x + y))))

    def words_near(c: Column) -> Column:
        return nearest(distance(word_counts(c, of_language(lambda k: list(COMMON[k]))), of_language(word_shares)), lambda k: distance(word_counts(c, literals(COMMON[k])), literals(word_shares(k))))

    word_distance = let(F.col("common"), words_near)

    n_words, repeated = F.col("words.n").cast("long"), F.col("words.repeated").cast("long")
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words)
    d = d.select(
        *go_on, "doc_id", n_words.alias("n_words"), (F.col("n_chars") - F.col("classes")[3]).cast("long").alias("word_chars"), F.col("n_symbols").cast("long"),
        F.col("n_dup_lines").cast("long"), repeated.alias("n_repeat_words"), failed.alias("base_failed"),
        F.when(F.col("n_chars") >= MIN_CHARS, class_distance).alias("class_distance"),
        F.when(F.col("common.n") >= MIN_COMMON_WORDS, word_distance).alias("word_distance"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    d = d.withColumn("kept", ~F.col("base_failed") & near)
    return d.withColumnRenamed("carried", carry) if carry else d


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that the rules reject. Verdicts ride on the row itself, so nothing is joined."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = score_documents(whole.select("row", F.col(f"row.{id_col}").alias("doc_id"), F.col(f"row.{text_col}").alias("text"), F.col(f"row.{lang_col}").alias("lang")), carry="row")
    return judged.where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same in DuckDB's SQL, over the view ``documents``."""
    strip = lambda p: f"length(regexp_replace(text, {_quoted(p)}, '', 'g'))"
    def js(counts: str, shares: tuple[float, ...]) -> str:
        q = "[" + ", ".join(repr(x) for x in shares) + "]"
        p = f"({counts}[i] / list_sum({counts})::DOUBLE)"
        m = f"(({p} + {q}[i]) / 2)"
        term = f"(CASE WHEN {counts}[i] > 0 THEN {p} * log2({p} / {m}) ELSE 0.0 END + {q}[i] * log2({q}[i] / {m})) / 2"
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {len(shares) + 1}), lambda i: {term}))))"
    def common(k: str) -> str:
        return "[" + ", ".join(f"len(list_filter(plain, lambda x: x = {_quoted(w)}))" for w in COMMON[k]) + "]"
    def pick(col: str, to) -> str:
        return "CASE lang " + " ".join(f"WHEN '{k}' THEN {to(k)}" for k in CLASSES) + f" ELSE least({', '.join(to(k) for k in CLASSES)}) END AS {col}"
    ws = _quoted(WS)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, lang, text, length(text) AS n_chars, list_filter(regexp_split_to_array(text, {ws}), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D\\x20]')) AS lines,
  list_filter(regexp_split_to_array(lower(text), {_quoted(NOT_LETTERS)}), lambda x: x <> '') AS plain,
  [{', '.join(f"length(text) - {strip(p)}" for p in CLASS_PATTERNS)}] AS c5,
  length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols FROM d),
b AS (SELECT *, list_append(c5, n_chars - list_sum(c5)::BIGINT) AS c6, {', '.join(f'list_append({common(k)}, len(plain) - list_sum({common(k)})::BIGINT) AS c_{k}' for k in COMMON)} FROM a),
g AS (SELECT row_number() OVER () AS rid, * FROM b),
win AS (SELECT rid, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: struct_pack(k := array_to_string(w[i:i+{WINDOW - 1}], ' '), i := i))) AS x FROM g WHERE len(w) > {WINDOW}),
dup AS (SELECT rid, x.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x.k) > 1),
rep AS (SELECT rid, sum(n) AS n FROM (SELECT rid, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -{WINDOW})) AS n FROM dup) GROUP BY rid),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, (n_chars - c5[4])::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_chars, len(plain) AS n_plain,
  {pick('cd', lambda k: js('c6', class_shares(k)))}, {pick('wd', lambda k: js(f'c_{k}', word_shares(k)))}
  FROM g LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {MIN_CHARS} AND cd > {MAX_CLASS_DISTANCE}) AND NOT (n_plain >= {MIN_COMMON_WORDS} AND wd > {MAX_WORD_DISTANCE}) AS kept
FROM v"""
