"""The engine's functions for plain SQL, as SQL-bodied functions of the session.

``register(spark)`` makes scalar functions. Catalyst replaces a call by its body over an own projection that holds the
arguments, so an argument is evaluated once, no Python runs, and whatever optimizes a plan optimizes these.
``register_tables(spark, ...)`` makes table functions over views of results, suites and providers, so a ranking can be
read like a table. They can't be called inside lambdas, which is Spark's rule for SQL-bodied functions.

Numbers, patterns and word lists come from the modules that the DataFrame functions use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import dims, predicates, rankings, worklist
from .metrics import ALPHABET_SIZE
from .text import BETWEEN, CONTRACTION, DIGITS, LARGEST, WS
from .words import CONTRACTIONS, DE_FILLERS, EN_FILLERS, english_below_thousand, german_below_thousand

#: White space; one comparison settles that an ASCII letter isn't.
SPACES = rf"[[^!-\x{{9f}}]&&[{WS}]]+"


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(xs) -> str:
    return "array(" + ", ".join(map(literal, xs)) + ")"


def _listed(xs) -> str:
    return f"split({literal('|'.join(xs))}, '[|]')"


def _case(column: str, pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {literal(v) if isinstance(v, str) else v}" for test, v in pairs) + f" ELSE {otherwise} END"


def _rewritten(t: str, pattern: str, to: str) -> str:
    """Every match of a pattern replaced by ``to``, where it is x."""
    p = literal(pattern)
    return f"array_join(zip_with(split({t}, {p}, -1), transform(regexp_extract_all({t}, {p}, 0), x -> {to}), (a, b) -> concat(a, coalesce(b, ''))), '')"


def _split(t: str, pattern: str) -> str:
    """What stands between the matches. ``split`` compiles a pattern anew for each row, a lone space it doesn't; the pattern
    of a replacement is compiled once."""
    return f"split(regexp_replace({t}, {literal(pattern)}, ' '), ' ')"


def _in_order(few: str, many: str) -> str:
    """Whether all of ``few`` is in ``many``, one after the other: each is looked for behind the one before."""
    return f"aggregate({many}, 0, (k, x) -> CASE WHEN x = get({few}, k) THEN k + 1 ELSE k END) = size({few})"


def _words_of(n: str, lang: str) -> str:
    listed = _listed(german_below_thousand() if lang == "de" else english_below_thousand())
    low, high = f"get({listed}, CAST({n} % 1000 AS INT))", f"get({listed}, CAST(floor({n} / 1000) AS INT))"
    inside = f"WHEN NOT {n} BETWEEN 0 AND {LARGEST} THEN NULL"
    if lang == "de":
        return f"CASE {inside} WHEN {n} = 0 THEN 'null' WHEN {n} = 1 THEN 'eins' WHEN {n} < 1000 THEN {low} ELSE concat({high}, 'tausend', {low}) END"
    return f"CASE {inside} WHEN {n} = 0 THEN 'zero' WHEN {n} < 1000 THEN {low} WHEN {n} % 1000 = 0 THEN concat({high}, ' thousand') ELSE concat({high}, ' thousand ', {low}) END"


def scalar_functions() -> dict[str, str]:
    """Signature and result of each function, and its body; a body may call those before it."""
    known = "map(" + ", ".join(literal(x) for kv in CONTRACTIONS.items() for x in kv) + ")"
    number = "try_cast(x AS BIGINT)"
    spelled = f"coalesce(CASE WHEN coalesce(lang, '') = 'de' THEN {_words_of(number, 'de')} ELSE {_words_of(number, 'en')} END, x)"
    both = dict.fromkeys((*EN_FILLERS, *DE_FILLERS))
    fillers = f"CASE WHEN coalesce(lang, '') = 'de' THEN {_array(DE_FILLERS)} ELSE {_array(EN_FILLERS)} END"
    alphabet = literal("".join(map(chr, range(0x4E00, 0x4E00 + ALPHABET_SIZE))))
    letters = lambda ws: f"array_join(transform({ws}, w -> substring({alphabet}, CAST(array_position(v, w) AS INT), 1)), '')"
    status, error = "coalesce(status, '')", "coalesce(error, '')"
    return {
        "squeeze(t STRING) RETURNS STRING": f"trim(regexp_replace(t, {literal(f'[{WS}]+')}, ' '))",
        "number_words_en(n BIGINT) RETURNS STRING": _words_of("n", "en"),
        "number_words_de(n BIGINT) RETURNS STRING": _words_of("n", "de"),
        "expand_contractions(t STRING) RETURNS STRING": f"CASE WHEN t RLIKE \"['’]\" THEN {_rewritten('t', CONTRACTION, f'coalesce(try_element_at({known}, replace(x, {literal(chr(0x2019))}, {literal(chr(39))})), x)')} ELSE t END",
        "spoken_words(t STRING, lang STRING) RETURNS ARRAY<STRING>": f"CASE WHEN t RLIKE '[0-9]' THEN transform({_split('t', BETWEEN)}, y -> CASE WHEN y RLIKE '[0-9]' THEN {_rewritten('y', DIGITS, spelled)} ELSE y END) ELSE {_split('t', BETWEEN)} END",
        # only texts with a filler are filtered word by word
        "without(ws ARRAY<STRING>, some ARRAY<STRING>) RETURNS ARRAY<STRING>": "CASE WHEN arrays_overlap(ws, some) THEN filter(ws, x -> NOT array_contains(some, x)) ELSE ws END",
        "normalize_text(t STRING, lang STRING) RETURNS STRING": f"array_join(without(array_remove(spoken_words(CASE WHEN lang = 'en' THEN expand_contractions(lower(t)) ELSE lower(t) END, lang), ''), {fillers}), ' ')",
        "normalize_code(t STRING) RETURNS STRING": f"squeeze(array_join(filter(split(t, {literal(f'[{WS}]+')}), x -> NOT array_contains({_array(both)}, lower(x))), ' '))",
        "words_of(t STRING) RETURNS ARRAY<STRING>": f"array_remove({_split('t', SPACES)}, '')",
        # of normalized texts, which hold no other white space
        "spaced(t STRING) RETURNS ARRAY<STRING>": "array_remove(split(t, ' '), '')",
        "edit_rate(n_ref BIGINT, n_hyp BIGINT, distance BIGINT) RETURNS DOUBLE": "CASE WHEN n_ref = 0 AND n_hyp = 0 THEN 0D WHEN n_ref = 0 OR n_hyp = 0 THEN 1D ELSE least(distance / n_ref, 1D) END",
        "encoded_distance(r ARRAY<STRING>, h ARRAY<STRING>, v ARRAY<STRING>) RETURNS BIGINT": f"CASE WHEN size(v) > {ALPHABET_SIZE} THEN raise_error('too many different words in a pair') ELSE levenshtein({letters('r')}, {letters('h')}) END",
        # what lacks some of a sequence and has the rest in order is as far from it as it is shorter; a null decides nothing
        "some_of(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN": f"CASE WHEN size(a) < size(b) THEN {_in_order('a', 'b')} ELSE {_in_order('b', 'a')} END",
        # arguments are evaluated whatever the body does with them, so that those of a rare case are null without it
        "word_distance_unless(r ARRAY<STRING>, h ARRAY<STRING>, easy BOOLEAN) RETURNS BIGINT": "CASE WHEN easy THEN abs(size(r) - size(h)) ELSE encoded_distance(r, h, CASE WHEN NOT easy THEN array_distinct(concat(r, h)) END) END",
        "word_distance(r ARRAY<STRING>, h ARRAY<STRING>) RETURNS BIGINT": "word_distance_unless(r, h, some_of(r, h))",
        # near texts in a band of the edit table, whose width the lengths tell; only far ones in all of it
        "near_distance(a STRING, b STRING, n INT, m INT) RETURNS BIGINT": "coalesce(nullif(levenshtein(a, b, abs(n - m) + CAST(greatest(n, m) / 16 AS INT)), -1), levenshtein(a, b))",
        # texts split at each space lose nothing, so that words in order are characters in order
        "text_distance_unless(a STRING, b STRING, easy BOOLEAN) RETURNS BIGINT": "CASE WHEN easy THEN abs(char_length(a) - char_length(b)) ELSE near_distance(a, b, char_length(a), char_length(b)) END",
        "text_distance(a STRING, b STRING) RETURNS BIGINT": "text_distance_unless(a, b, some_of(split(a, ' '), split(b, ' ')))",
        "word_error_rate(r ARRAY<STRING>, h ARRAY<STRING>) RETURNS DOUBLE": "edit_rate(size(r), size(h), word_distance(r, h))",
        "wer(reference STRING, hypothesis STRING) RETURNS DOUBLE": "word_error_rate(words_of(reference), words_of(hypothesis))",
        "cer(reference STRING, hypothesis STRING) RETURNS DOUBLE": "edit_rate(char_length(reference), char_length(hypothesis), text_distance(reference, hypothesis))",
        "wer_raw(reference STRING, hypothesis STRING) RETURNS DOUBLE": "wer(lower(reference), lower(hypothesis))",
        "wer_normalized(reference STRING, hypothesis STRING, lang STRING) RETURNS DOUBLE": "word_error_rate(spaced(normalize_text(reference, lang)), spaced(normalize_text(hypothesis, lang)))",
        "cer_normalized(reference STRING, hypothesis STRING, lang STRING) RETURNS DOUBLE": "cer(normalize_text(reference, lang), normalize_text(hypothesis, lang))",
        "code_wer(reference STRING, hypothesis STRING) RETURNS DOUBLE": "CASE WHEN coalesce(reference, '') <> '' THEN wer(normalize_code(reference), normalize_code(hypothesis)) END",
        "code_cer(reference STRING, hypothesis STRING) RETURNS DOUBLE": "CASE WHEN coalesce(reference, '') <> '' THEN cer(normalize_code(reference), normalize_code(hypothesis)) END",
        "leading_int(t STRING) RETURNS BIGINT": r"try_cast(regexp_extract(t, '^\\s*([+-]?\\d+)', 1) AS BIGINT)",
        "is_skipped(status STRING) RETURNS BOOLEAN": f"{status} = 'skipped'",
        "is_error(status STRING, error STRING) RETURNS BOOLEAN": f"{status} = 'error' OR {error} <> ''",
        "is_valid(status STRING, error STRING) RETURNS BOOLEAN": f"{status} <> 'skipped' AND {status} <> 'error' AND {error} = ''",
        "slices_of(test_id STRING) RETURNS ARRAY<STRING>": "filter(array(" + ", ".join(f"CASE WHEN test_id RLIKE {literal(p)} THEN {literal(s)} END" for s, p in predicates.SLICES.items()) + "), x -> x IS NOT NULL)",
        "infer_category(suite_id STRING) RETURNS STRING": _case("suite_id", [(f"startswith(suite_id, {literal(p)})", c) for p, c in dims.CATEGORY_BY_PREFIX.items()], "'clean-speech'"),
        "infer_language(suite_id STRING) RETURNS STRING": "coalesce(nullif(regexp_extract(suite_id, '-(de|en|auto)$', 1), ''), 'de')",
        "price_per_minute(provider STRING, model STRING) RETURNS DOUBLE": _case(
            "provider", [(f"provider = {literal(p)} AND model = {literal(m)}", v) for (p, m), v in worklist.PRICES.items()] + [(f"provider = {literal(p)}", v) for p, v in worklist.PROVIDER_PRICES.items()], "0D"
        ),
        "cache_key(suite_id STRING, test_id STRING, provider_id STRING, model STRING, run BIGINT) RETURNS STRING": "substring(sha1(concat_ws(':', suite_id, test_id, provider_id, model, CAST(run AS STRING))), 1, 16)",
        "realtime_factor(duration_ms DOUBLE, seconds DOUBLE) RETURNS DOUBLE": "CASE WHEN seconds > 0 THEN duration_ms / (seconds * 1000) ELSE 0D END",
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the scalar functions in this session and returns their names. Doing so again replaces them."""
    made = scalar_functions()
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in made]





def register_tables(spark: SparkSession, results: DataFrame, suites: DataFrame, providers: DataFrame | None = None) -> list[str]:
    """Makes table functions ``rankings()``, ``rankings_by_suite()``, ``rankings_by_category()``, ``rankings_by_slice()`` and
    ``suite_dimension()`` over these frames. Their plans are inlined: a filter on a table function reaches the results' scan."""
    made = {
        "rankings": rankings.rank_models(results, providers=providers),
        "rankings_by_suite": rankings.rank_models(results, "suite_id", providers=providers),
        "rankings_by_category": rankings.rank_by_category(results, suites, providers),
        "rankings_by_slice": rankings.rank_by_slice(results, providers),
        "suite_dimension": suites,
    }
    for name, frame in made.items():
        view = f"verdigris_{name}"
        frame.createOrReplaceTempView(view)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE({columns}) RETURN SELECT * FROM {view}")
    return list(made)
