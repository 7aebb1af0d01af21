"""Transcript metrics: word and character error rates as Column expressions, and all metrics of transcripts in one frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import edit
from .align import align_scores, alignment, word_marks
from .text import WS, let, normalize_by, normalize_code

__all__ = ["align_scores", "alignment", "best_alternative", "cer", "code_cer", "code_wer", "distance", "parse_int", "score_transcripts", "wer", "wer_raw", "word_marks", "words"]

#: One character for each different word of a pair, of a literal alphabet; pairs with more take code points from WIDE on.
ALPHABET_SIZE = 20_000
WIDE = 0x10000
#: Pairs of texts up to this length are compared in Arrow batches, a whole batch at once; longer ones by the built-in distance.
SHORT = 1024


def _alphabet() -> Column:
    return F.lit("".join(map(chr, range(0x4E00, 0x4E00 + ALPHABET_SIZE))))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda x: x != "")


def _encoded(ws: Column, vocabulary: Column, wide: bool = False) -> Column:
    def letter(w: Column) -> Column:
        at = F.array_position(vocabulary, w).cast("int")
        return F.decode(F.unhex(F.lpad(F.hex(at + WIDE), 8, "0")), "UTF-32") if wide else F.substring(_alphabet(), at, F.lit(1))

    return F.array_join(F.transform(ws, letter), "")


def distance(a: list, b: list) -> int:
    """Edit distance with unit costs."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two arrays of words, by the built-in distance of strings with a character for each word."""

    def of(v: Column) -> Column:
        many = F.levenshtein(_encoded(reference, v, True), _encoded(hypothesis, v, True))
        return F.when(F.size(v) > ALPHABET_SIZE, many).otherwise(F.levenshtein(_encoded(reference, v), _encoded(hypothesis, v)))

    return let(F.array_distinct(F.concat(reference, hypothesis)), of)


def _rate(n_ref: Column, n_hyp: Column, dist: Column) -> Column:
    return F.when((n_ref == 0) & (n_hyp == 0), 0.0).when((n_ref == 0) | (n_hyp == 0), 1.0).otherwise(F.least(dist / n_ref, F.lit(1.0)))


@F.arrow_udf(T.DoubleType())
def _word_rates(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return edit.where_both(lambda r, h: edit.word_rates(r, h, f"[{WS}]+"), reference, hypothesis)


@F.arrow_udf(T.DoubleType())
def _character_rates(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return edit.where_both(edit.character_rates, reference, hypothesis)


@F.arrow_udf(T.DoubleType())
def _least_word_rates(references: pa.Array, hypothesis: pa.Array) -> pa.Array:
    row, flat = pc.list_parent_indices(references), references.flatten()
    rates = edit.where_both(lambda r, h: edit.word_rates(r, h, f"[{WS}]+"), flat, hypothesis.take(row)).to_numpy(zero_copy_only=False)
    least = np.full(len(references), np.inf)
    np.minimum.at(least, row.to_numpy(), rates)
    return pa.array(least, mask=~np.isfinite(least))


def _short(text: Column) -> Column:
    return F.char_length(text) <= SHORT


def _built_in_wer(reference: Column, hypothesis: Column) -> Column:
    pair = F.struct(words(reference).alias("r"), words(hypothesis).alias("h"))
    return F.transform(F.array(pair), lambda p: _rate(F.size(p["r"]), F.size(p["h"]), word_distance(p["r"], p["h"])))[0]


def _batched(rates, built_in, reference: Column, hypothesis: Column) -> Column:
    both = _short(reference) & _short(hypothesis)
    return F.coalesce(rates(F.when(both, reference), F.when(both, hypothesis)), built_in(reference, hypothesis))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate, 1 at most: both empty 0, one empty 1."""
    return _batched(_word_rates, _built_in_wer, reference, hypothesis)


def _built_in_cer(reference: Column, hypothesis: Column) -> Column:
    return _rate(F.char_length(reference), F.char_length(hypothesis), F.levenshtein(reference, hypothesis))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate over code points, spaces included, 1 at most."""
    return _batched(_character_rates, _built_in_cer, reference, hypothesis)


def wer_raw(reference: Column, hypothesis: Column) -> Column:
    return wer(F.lower(reference), F.lower(hypothesis))


def code_wer(reference: Column, hypothesis: Column) -> Column:
    """Null without a code reference."""
    return F.when(F.coalesce(reference, F.lit("")) != "", wer(normalize_code(reference), normalize_code(hypothesis)))


def code_cer(reference: Column, hypothesis: Column) -> Column:
    return F.when(F.coalesce(reference, F.lit("")) != "", cer(normalize_code(reference), normalize_code(hypothesis)))


def best_alternative(reference: Column, alternatives: Column, hypothesis: Column) -> Column:
    """Least WER over a reference and its alternatives, all normalized; null without alternatives."""
    every = F.concat(F.array(reference), alternatives)
    some = F.size(F.coalesce(alternatives, F.array().cast("array<string>"))) > 0
    short = some & _short(hypothesis) & F.forall(every, lambda r: F.coalesce(_short(r), F.lit(False)))
    built_in = F.array_min(F.transform(every, lambda r: _built_in_wer(r, hypothesis)))
    return F.when(some, F.coalesce(_least_word_rates(F.when(short, every), F.when(short, hypothesis)), built_in))


def score_transcripts(d: DataFrame, reference: str, hypothesis: str, lang: str, code: str | None = None, alternatives: str | None = None, formatted: str | None = None) -> DataFrame:
    """``d`` with the eight metrics of its transcripts. Optional metrics are null without their reference.

    Both sides are normalized once, as columns of a stage of their own: Catalyst keeps what several metrics read apart.
    """
    none, kept = F.lit(None).cast("double"), d.columns
    ref, hyp = F.col(reference), F.col(hypothesis)
    sides = {"__ref": normalize_by(ref, F.col(lang)), "__hyp": normalize_by(hyp, F.col(lang))}
    if alternatives:
        sides["__all"] = F.transform(alternatives, lambda x: normalize_by(x, F.col(lang)))
    if code:
        sides |= {"__code": normalize_code(F.col(code)), "__said": normalize_code(hyp)}
    d = d.withColumns(sides)
    has_code = F.coalesce(F.col(code), F.lit("")) != "" if code else None
    metrics = {
        "wer_raw": wer_raw(ref, hyp), "wer_normalized": wer(F.col("__ref"), F.col("__hyp")), "cer": cer(F.col("__ref"), F.col("__hyp")),
        "code_wer_normalized": F.when(has_code, wer(F.col("__code"), F.col("__said"))) if code else none,
        "code_cer": F.when(has_code, cer(F.col("__code"), F.col("__said"))) if code else none,
        "best_alternative_wer": best_alternative(F.col("__ref"), F.col("__all"), F.col("__hyp")) if alternatives else none,
    }
    out = d.select(*kept, *[c.alias(n) for n, c in metrics.items()])
    if not formatted:
        return out.withColumns({"punctuation_score": none, "formatting_score": none})
    own = F.col(formatted)
    scored = out.withColumn("__s", alignment(F.when(own != "", own), hyp))
    return scored.withColumns({"punctuation_score": F.col("__s.punctuation_score"), "formatting_score": F.col("__s.formatting_score")}).drop("__s")


def parse_int(text: Column) -> Column:
    """Leading integer of a text, null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
