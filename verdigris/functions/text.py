"""Text normalization for transcripts, as Column expressions.

Order matters: lower case, contractions (English), punctuation to spaces, numbers to words, fillers, white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CONTRACTIONS, DE_FILLERS, EN_FILLERS, english_below_thousand, german_below_thousand

#: White space as the evaluated systems' runtime has it: Java's own, and what it leaves out.
WS = r"\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Word boundaries on ASCII word characters only.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
CONTRACTION = f"{BEFORE}[a-z]+['’][a-z]+{AFTER}"
DIGITS = f"{BEFORE}[0-9]+{AFTER}"
#: What stands between words once punctuation has become white space. Most letters are a to z, which is found out soonest.
BETWEEN = r"[^a-z\p{L}\p{N}]+"
LARGEST = 999_999


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def rewrite(text: Column, pattern: str, to: Callable[[Column], Column]) -> Column:
    """Every match of ``pattern`` replaced by ``to`` of it, in one pass."""

    def once(t: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), to)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), matches, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(text, once)


def _list(values) -> Column:
    return F.split(F.lit("|".join(values)), r"\|")


def _below(words: list[str], n: Column) -> Column:
    return F.get(_list(words), n.cast("int"))


def number_words_en(n: Column) -> Column:
    """0 to 999,999 in English words; null beyond."""
    words = english_below_thousand()
    high, low = _below(words, F.floor(n / 1000)), _below(words, n % 1000)
    out = F.when(n == 0, "zero").when(n < 1000, low).when(n % 1000 == 0, F.concat(high, F.lit(" thousand"))).otherwise(F.concat(high, F.lit(" thousand "), low))
    return F.when(n.between(0, LARGEST), out)


def number_words_de(n: Column) -> Column:
    """0 to 999,999 in German words; null beyond. Only a lone 1 is "eins"."""
    words = german_below_thousand()
    high, low = _below(words, F.floor(n / 1000)), _below(words, n % 1000)
    out = F.when(n == 0, "null").when(n == 1, "eins").when(n < 1000, low).otherwise(F.concat(high, F.lit("tausend"), low))
    return F.when(n.between(0, LARGEST), out)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def without_fillers(text: Column, fillers: tuple[str, ...], key: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.array_join(F.filter(F.split(text, f"[{WS}]+"), lambda x: ~key(x).isin(*fillers)), " ")


def _is(lang: Column | str, name: str) -> Column:
    return F.lit(lang == name) if isinstance(lang, str) else F.coalesce(lang == name, F.lit(False))


def normalize_text(text: Column, lang: Column | str = "en") -> Column:
    """``lang``, a value or a column: "en", "de", or another one, which takes English rules but expands no contractions.
    Null text stays null. Each text is split into words once; only texts with an apostrophe or a digit take further steps."""
    de, en = _is(lang, "de"), _is(lang, "en")
    known = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])

    def expand(t: Column) -> Column:
        return rewrite(t, CONTRACTION, lambda m: F.coalesce(F.try_element_at(known, F.replace(m, F.lit("’"), F.lit("'"))), m))

    def spell(m: Column) -> Column:
        n = m.try_cast("bigint")
        return F.coalesce(F.when(de, number_words_de(n)).otherwise(number_words_en(n)), m)

    def spoken(t: Column) -> Column:
        parts = F.split(t, BETWEEN)
        spelled = F.transform(parts, lambda x: F.when(x.rlike("[0-9]"), rewrite(x, DIGITS, spell)).otherwise(x))
        every = F.when(t.rlike("[0-9]"), spelled).otherwise(parts)
        return F.array_join(F.filter(every, lambda x: (x != "") & ~F.when(de, x.isin(*DE_FILLERS)).otherwise(x.isin(*EN_FILLERS))), " ")

    lower = F.lower(text)
    return let(let(lower, lambda t: F.when(en & t.rlike("['’]"), expand(t)).otherwise(t)), spoken)


def normalize_by(text: Column, lang: Column) -> Column:
    """``normalize_text`` by a language column."""
    return normalize_text(text, lang)


def normalize_code(text: Column) -> Column:
    """Case, punctuation and digits stay; fillers of both languages go, matched in lower case as whole tokens."""
    both = tuple(dict.fromkeys((*EN_FILLERS, *DE_FILLERS)))
    return squeeze(without_fillers(text, both, F.lower))
