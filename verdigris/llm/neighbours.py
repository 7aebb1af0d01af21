"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: hashed character trigrams in lower case, trigrams of character classes, and how much it
repeats its words and lines. Terms are weighted by inverse document frequency and projected on the leading singular
vectors of labelled texts. Those texts' latent vectors are broadcast; for every document all cosine products with them
are computed, in blocks, and the ``k`` nearest vote for their label with their similarity to the power ``SHARPNESS``.

The classifier is fitted on at most ``sample`` labelled texts of each label, those of the least hash of their id. So
what the driver holds and what is broadcast is bounded: ``2 * sample`` rows of ``TERMS`` half floats, and of
``dimensions`` floats. Labels come from rows with ``crc32(id) % FOLDS`` other than ``HELD_OUT`` alone; label, language,
source and id are no input of a score. A labelled text that equals the document doesn't vote, so that no document is
scored by its own label.

Null texts are empty. A text without terms, or one near to no labelled text, has the labels' overall share as its
score; without labels that is 0.5. Of an id's repeated labels the least counts; labels other than 0 and 1, and null
ids, don't. Repeated documents have a row each. Long texts are taken whole, ``PIECE`` bytes at a time. Other columns of
either table stay behind, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_and_text

FOLDS, HELD_OUT = 3, 1
GRAMS, CLASSES, BINS = 1024, 10, 8
TERMS = GRAMS + CLASSES**3 + 3 * BINS
PIECE = 1 << 20
BLOCK = 256
SHARPNESS = 4
SAME = 1 - 1e-5

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
SCORED_DDL = "doc_id long, held_out boolean, score double, predicted int"


def _classes() -> np.ndarray:
    """The class of each byte: lower, upper, beyond ASCII, digit, space, new line, full stop or comma, bracket or quote, symbol, control."""
    out = np.full(256, 9, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "", "0123456789", " ", "\n", ".,", "()[]{}\"'`:;-_/\\", "!?#*$%&|<>@^~+=")):
        for c in chars:
            out[ord(c)] = k
    out[128:] = 2
    return out


CLASS_OF = _classes()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.int64)


def _soft(x: float) -> np.ndarray:
    """A share as weights of the two bins it lies between."""
    out, at = np.zeros(BINS), min(max(x, 0.0), 1.0) * (BINS - 1)
    low = int(at)
    out[low] = 1 - (at - low)
    if low + 1 < BINS:
        out[low + 1] = at - low
    return out


def term_counts(text: str) -> np.ndarray:
    """Counts of the terms of a text; its last bins are shares."""
    out = np.zeros(TERMS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    for at in range(0, max(0, len(raw) - 2), PIECE):
        b = raw[at : at + PIECE + 2]
        low, kind = LOWER[b], CLASS_OF[b]
        gram = ((low[:-2] * 961 + low[1:-1] * 31 + low[2:]) * 2654435761 >> 7) % GRAMS
        out[:GRAMS] += np.bincount(gram, minlength=GRAMS)
        out[GRAMS:-3 * BINS] += np.bincount(kind[:-2] * CLASSES**2 + kind[1:-1] * CLASSES + kind[2:], minlength=CLASSES**3)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    if words:
        again = sum(map(eq, words, words[1:])) / len(words)
        shares = (len(set(words)) / len(words), again, len(set(lines)) / max(1, len(lines)))
        out[-3 * BINS :] = np.concatenate([_soft(x) for x in shares])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares within each kind of term: each kind has length 1, or 0."""
    parts = (counts[:, :GRAMS], counts[:, GRAMS : -3 * BINS], counts[:, -3 * BINS :])
    return np.concatenate([np.sqrt(p / np.maximum(p.sum(1, keepdims=True), 1e-12)) for p in parts], 1).astype(np.float32)


class Voters:
    """The fitted classifier: term weights, singular vectors, the labelled latent vectors and their labels."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, totals: tuple[int, int], dimensions: int, k: int):
        self.k, self.labels = k, labels
        n = max(1, len(terms))
        self.idf = np.log((1 + n) / (1 + (terms > 0).sum(0))).astype(np.float32) + 1 if len(terms) else np.ones(TERMS, np.float32)
        x = terms.astype(np.float32) * self.idf
        d = min(dimensions, TERMS)
        q = np.random.default_rng(0).standard_normal((TERMS, d + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q, _ = np.linalg.qr(x.T @ (x @ q))
        inner = x @ q
        _, turn = np.linalg.eigh((inner.T @ inner).astype(np.float64))
        self.axes = (q @ turn[:, ::-1][:, :d].astype(np.float32)).astype(np.float32)
        self.vectors = _unit(x @ self.axes)
        # a label's sampled texts stand for all of its texts
        drawn = np.maximum(np.bincount(labels, minlength=2), 1)
        self.weights = (np.array(totals, np.float64) / drawn)[labels] if len(labels) else np.zeros(0)
        self.share = totals[1] / sum(totals) if sum(totals) else 0.5

    def latent(self, terms: np.ndarray) -> np.ndarray:
        return _unit((terms * self.idf) @ self.axes)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """The share of label 1 among the votes of the nearest, to six digits."""
        if not len(self.labels):
            return np.full(len(terms), self.share)
        near = self.latent(terms) @ self.vectors.T
        near[near > SAME] = 0
        k = min(self.k, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        votes = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS * self.weights[top]
        all_ = votes.sum(1)
        return np.round(np.where(all_ > 0, (votes * self.labels[top]).sum(1) / np.where(all_ > 0, all_, 1), self.share), 6)


def _fold(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [weighted(term_counts(t)[None])[0].astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, dimensions: int, k: int) -> Voters:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (_fold("doc_id") != HELD_OUT)).groupBy("doc_id").agg(F.min("label").alias("label"))
    drawn, totals = [], {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    for label in (0, 1):
        drawn += known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["label"]) for r in drawn], "doc_id long, label int")
    rows = key_and_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    found: dict[tuple[int, bytes], int] = {}
    for r in rows.mapInArrow(_terms, "doc_id long, label int, terms binary").dropDuplicates(["doc_id"]).collect():  # 2 * sample rows at most
        found[(r["doc_id"], bytes(r["terms"]))] = r["label"]
    order = sorted(found)
    terms = np.stack([np.frombuffer(t, np.float16) for _, t in order]) if order else np.zeros((0, TERMS), np.float16)
    return Voters(terms, np.array([found[x] for x in order], np.int64), (totals.get(0, 0), totals.get(1, 0)), dimensions, k)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4096, dimensions: int = 64, k: int = 25
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; one pass, no shuffle of texts."""
    voters = fit(docs, labels, id_col, text_col, label_col, sample, dimensions, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                score = voters.score(np.concatenate([weighted(term_counts(t)[None]) for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=SCORED)

    held = F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out")
    return key_and_text(docs, id_col, text_col).select("doc_id", "text", held).mapInArrow(run, SCORED_DDL)
