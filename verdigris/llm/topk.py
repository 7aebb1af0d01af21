"""Exact top-k by inner product with norm-bucketed retrieval.

Queries are dealt into chunks of bounded size and vectors into groups by a hash of their id; each (chunk, group) is
one unit of work, so equal or frequent vectors spread over all of them. A unit reads its vectors in order of length
and cuts them into buckets. A query's k-th best score so far, divided by its own length and the bucket's greatest, is
the bucket's local cosine threshold. Over 1 the bucket is skipped (length pruning). Where the threshold is high, the
query's largest coordinate confines the same coordinate of any vector that can still qualify to an interval, and only
vectors inside it are verified (coordinate pruning). Otherwise the bucket is verified as a whole. Verification is the
integer product.

Vectors that are null or hold null or non-finite components take no part. Empty tables give no rows. Ties go to the
smaller id; rows of equal id are candidates each, but never their own query's. Vectors of other widths than a query
are not its candidates. Components and scores beyond 64 bits count as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_CHUNK = 32_768
BUCKET = 4096
#: Local thresholds from which coordinates prune.
COORDINATE_FROM = 0.5
MARGIN = 1e-9
LONG = np.iinfo(np.int64)

PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
PAIR_DDL = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *carry: str) -> DataFrame:
    """(vec_id, carried columns, v: array of long, norm2) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    whole = F.forall(F.col("x"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), *carry, v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(whole)
    d = d.select("vec_id", *carry, F.transform("x", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))
    return d.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
        return keep[np.lexsort((ids[keep], ~scores[keep]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


class Retrieval:
    """One unit of work and one width of vectors: its queries, and the best of what they have met."""

    def __init__(self, k: int, ids: list[int], data: np.ndarray):
        self.k, self.ids, self.q = k, np.array(ids, np.int64), data
        self.length = np.sqrt((data.astype(np.float64) ** 2).sum(1))
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(ids)
        self.floor = np.full(len(ids), -np.inf)  # for pruning, which allows for rounding
        self.least = np.full(len(ids), LONG.min, np.int64)  # the same, exactly
        self.focus = np.abs(data).argmax(1) if data.shape[1] else np.zeros(len(ids), np.int64)

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        longest = float(length.max())
        unit = v / np.where(length > 0, length, 1)[:, None]
        bound = self.length * longest
        exact = longest * self.length.max(initial=0.0) < 2**52  # doubles hold all partial sums exactly
        vf = v.astype(np.float64)
        everything = np.arange(len(ids))
        for i in np.flatnonzero(self.floor <= bound * (1 + MARGIN) + MARGIN).tolist():
            local = self.floor[i] / bound[i] if bound[i] > 0 else -np.inf
            inside = everything
            if local >= COORDINATE_FROM:
                f = int(self.focus[i])
                angle, turn = math.acos(max(-1.0, min(1.0, self.q[i, f] / self.length[i]))), math.acos(min(1.0, local))
                low, high = math.cos(min(math.pi, angle + turn)), math.cos(max(0.0, angle - turn))
                inside = np.flatnonzero((unit[:, f] >= low - 1e-6) & (unit[:, f] <= high + 1e-6))
            if exact:
                s = (vf[inside] @ self.q[i].astype(np.float64)).astype(np.int64)
            else:
                x = self.q[i].tolist()
                s = np.array([min(max(sum(a * b for a, b in zip(r, x, strict=True)), LONG.min), LONG.max) for r in v[inside].tolist()], np.int64)
            ok = (s >= self.least[i]) & (ids[inside] != self.ids[i])
            s, c = np.concatenate([self.best[i][0], s[ok]]), np.concatenate([self.best[i][1], ids[inside][ok]])
            top = _best(s, c, self.k)
            self.best[i] = (s[top], c[top])
            if len(top) == self.k:
                self.floor[i] = self.least[i] = s[top[-1]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 4096):
            part = self.best[at : at + 4096]
            q = np.repeat(self.ids[at : at + 4096], [len(b[0]) for b in part])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([b[1] for b in part])), pa.array(np.concatenate([b[0] for b in part]))], schema=PAIR)


def _retrieve(k: int):
    """Rows come by unit and width, queries before vectors, vectors by falling length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stage, work = None, None, None
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def turn() -> None:
            """What has been gathered becomes the queries, or meets them."""
            nonlocal work
            if stage == 0:
                work = Retrieval(k, ids, np.stack(rows))
            elif stage == 1 and work is not None and ids:
                work.meet(np.array(ids, np.int64), np.stack(rows))
            ids.clear()
            rows.clear()

        for batch in batches:
            unit, width, kind, name = (batch.column(i).to_pylist() for i in range(4))
            for key, stg, i, v in zip(zip(unit, width, strict=True), kind, name, batch.column(4), strict=True):
                if key != now or stg != stage:
                    turn()
                    if key != now:
                        if work is not None:
                            yield from work.rows()
                        now, work = key, None
                    stage = stg
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
                if stage == 1 and len(ids) == BUCKET:
                    turn()
        turn()
        if work is not None:
            yield from work.rows()

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, its own row left out."""
    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = integer_vectors(vectors, id_col, vec_col, scale)
    q = integer_vectors(queries, id_col, vec_col, scale)
    chunks = max(1, -(-q.count() // QUERY_CHUNK))
    row = [F.size("v").alias("width"), F.col("kind"), F.col("vec_id"), F.col("v"), F.col("norm2")]
    q = q.withColumn("kind", F.lit(0)).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    q = q.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select((F.col("chunk") * groups + F.col("copy")).alias("unit"), *row)
    v = v.withColumn("kind", F.lit(1)).withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)))
    v = v.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select((F.col("copy").cast("long") * groups + F.col("group")).alias("unit"), *row)
    order = ["unit", "width", "kind", F.desc("norm2"), "vec_id"]
    dealt = q.union(v).repartition(groups, "unit").sortWithinPartitions(*order).select("unit", "width", "kind", "vec_id", "v")
    found = dealt.mapInArrow(_retrieve(k), PAIR_DDL)
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
