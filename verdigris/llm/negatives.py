"""Hard negatives by a one-dimensional distance key.

A vector x gets one more component, the root of M^2 - |x|^2 with M the greatest length, so that all are equally long
and the squared distance to an anchor q, which gets a zero, is |q|^2 + M^2 - 2 qx: near means a high inner product. The
augmented vectors are stored sorted by (pivot, distance): each belongs to the nearest of a few pivots, and a pivot's
distances are cut into rings of about ``BLOCK`` rows. A ring whose distances lie in [a, b] holds nothing nearer to q
than |d(q, pivot) - [a, b]|, and nothing farther than d(q, pivot) + b.

A search first scans the one ring that promises most for an anchor. The k-th score found bounds the radius, and the second
round scans all other rings that reach inside it: what is left out is certified by its bound. Positives are the nearest
of the anchor's label; negatives of the others are looked for in an annulus, as their scores are bounded on both sides.

Pivots are the vectors of the least hash of their id, ``MOST_PIVOTS`` at most, of ``PIVOT_WIDTH`` components; rings are
``MOST_RINGS`` a pivot at most. So the directory of rings, which the driver holds and tasks get, is bounded. Every row is
in the index. A ring of more than ``BLOCK`` rows is dealt out by row number, and anchors come by chunks, so that no unit
of work grows with the data. Of rows that share vector and label only the first ``keep`` by id can be in an answer, as ties go to the smaller
id; the others leave before anything is searched, which takes hot vectors away.

Rows with null id, label or vector, or with null or non-finite components, take no part. A row that repeats another in
id, label and vector counts once; ids that recur with others are candidates each, never of their own id's anchor, and the
least (label, vector) is the anchor. Vectors of other widths than the anchor's are not its candidates. Components and
scores beyond 64 bits count as the nearest long. Empty tables give no rows. Other columns stay behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .topk import LONG, integer_vectors

BLOCK = 8192
MOST_PIVOTS, MOST_RINGS, PIVOT_WIDTH = 64, 64, 4096
ANCHOR_CHUNK = 262_144
ANCHORS_AT_ONCE = 256
#: Bounds allow for rounding by this share of the greatest length.
MARGIN = 1e-6

KEYED_DDL = "vec_id long, label int, v array<long>, norm2 double, pivot int, distance double"
FOUND_DDL = "anchor_id long, slot int, vec_id long, score long"
FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def reduced(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows of equal vector and label the ``keep`` of least id. Both shuffles combine before they send."""
    once = rows.groupBy("v", "label", "vec_id").agg(F.first("norm2").alias("norm2"))
    n = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    return once.withColumn("n", n).where(F.col("n") <= keep).select("vec_id", "label", "v", "norm2")


def _by_width(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each width."""
    at = values.offsets.to_numpy()
    width, flat = np.diff(at), values.values.to_numpy(zero_copy_only=False)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        yield rows, flat[at[rows][:, None] + np.arange(w)].reshape(len(rows), w)


class Pivots:
    """Points of the augmented space and the distances to them. Vectors of any width: what one lacks is zero."""

    def __init__(self, vectors: list[list[int]], most2: float):
        self.most2 = most2
        self.points = [np.array(v, np.float64) for v in vectors]
        self.norm2 = np.array([(p * p).sum() for p in self.points])
        self.extra = np.sqrt(np.maximum(most2 - self.norm2, 0))

    def distances(self, v: np.ndarray, norm2: np.ndarray, extra: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        products = np.stack([x[:, : len(p)] @ p[: x.shape[1]] for p in self.points], 1)
        own2, own_extra = norm2[:, None], extra[:, None]
        return np.sqrt(np.maximum(own2 + self.norm2 - 2 * products + (own_extra - self.extra) ** 2, 0))

    def of_rows(self, v: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return self.distances(v, norm2, np.sqrt(np.maximum(self.most2 - norm2, 0)))

    def of_anchors(self, v: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return self.distances(v, norm2, np.zeros(len(v)))


def _keyed(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nearest, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            norm2 = b.column(3).to_numpy()
            for rows, v in _by_width(b.column(2)):
                d = pivots.of_rows(v, norm2[rows])
                nearest[rows] = d.argmin(1)
                distance[rows] = d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest), pa.array(distance)], names=["vec_id", "label", "v", "norm2", "pivot", "distance"])

    return run


class Index:
    """The stored rows by (pivot, distance), and the directory of their rings."""

    def __init__(self, rows: DataFrame):
        n, most2 = rows.agg(F.count("*"), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
        blocks = max(1, -(-n // BLOCK))
        n_pivots = min(MOST_PIVOTS, max(1, math.isqrt(blocks)))
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(n_pivots).select(F.slice("v", 1, PIVOT_WIDTH).alias("v")).collect()
        self.pivots = Pivots(sorted({tuple(r["v"]) for r in drawn}) or [()], most2)
        n_rings = min(MOST_RINGS, max(1, blocks // len(self.pivots.points)))
        keyed = rows.mapInArrow(_keyed(self.pivots), KEYED_DDL)
        self.keyed = cut(keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id").withColumn("row", F.monotonically_increasing_id()), "index")
        edges = self.keyed.groupBy("pivot").agg(F.percentile_approx("distance", [i / n_rings for i in range(1, n_rings)] or [0.5], F.lit(10_000)).alias("edges")).collect()
        self.edges = {r["pivot"]: sorted(set(r["edges"])) if n_rings > 1 else [] for r in edges}  # MOST_PIVOTS rows of MOST_RINGS numbers
        self.rings, self.first = [], [0]
        per = self._ringed().groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("a"), F.max("distance").alias("b"))
        self.rings = sorted((r["pivot"], r["ring"], r["a"], r["b"], max(1, -(-r["n"] // (2 * BLOCK)))) for r in per.collect())
        self.first = np.cumsum([0] + [r[4] for r in self.rings]).tolist()  # a ring's first block

    def _ringed(self) -> DataFrame:
        """Rows with their ring and, where they are known, the ring's first block and how many it has. At most MOST_PIVOTS rows are broadcast."""
        places = {(r[0], r[1]): (first, r[4]) for r, first in zip(self.rings, self.first, strict=False)}
        rows = [(p, e, [places.get((p, i), (0, 1))[0] for i in range(len(e) + 1)], [places.get((p, i), (0, 1))[1] for i in range(len(e) + 1)]) for p, e in self.edges.items()]
        of = self.keyed.sparkSession.createDataFrame(rows, "pivot int, edges array<double>, firsts array<int>, parts array<int>")
        ring = F.aggregate("edges", F.lit(0), lambda n, e: n + (F.col("distance") > e).cast("int"))
        return self.keyed.join(F.broadcast(of), "pivot").withColumn("ring", ring)

    def placed(self) -> DataFrame:
        """Rows with their block: rings of many rows are dealt into several."""
        return self._ringed().select("vec_id", "label", "v", "distance", (F.get("firsts", "ring") + F.pmod(F.xxhash64("row"), F.get("parts", "ring"))).alias("block"))


def _routed(index_pivots: Pivots, rings: list[tuple], first: list[int], same: bool, seed: bool):
    """Adds to each anchor the blocks to scan. Its slots have bounds ``low`` and ``high`` of scores that count, ``done`` is the seed's ring."""
    ring_pivot = np.array([r[0] for r in rings], np.int64)
    a, b = np.array([r[2] for r in rings]), np.array([r[3] for r in rings])
    slack = MARGIN * math.sqrt(index_pivots.most2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            ring_of = np.full(batch.num_rows, -1, np.int32)
            norm2 = batch.column(3).to_numpy()
            low, high, done = batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_numpy()
            for rows, v in _by_width(batch.column(2)):
                d = index_pivots.of_anchors(v, norm2[rows])[:, ring_pivot]
                nearest = np.maximum(np.maximum(a - d, d - b), 0) - slack
                farthest = d + b + slack
                for i, row in enumerate(rows.tolist()):
                    if not low[row]:
                        continue
                    whole = norm2[row] + index_pivots.most2
                    # distances of the scores that count, for any slot: a higher score is nearer
                    lo, hi = np.array(low[row]), np.array(high[row])
                    lo, hi = lo[lo <= hi], hi[lo <= hi]
                    far = np.where(lo == LONG.min, np.inf, np.sqrt(np.maximum(whole - 2 * lo.astype(np.float64), 0)) + slack)
                    near = np.where(hi == LONG.max, 0, np.sqrt(np.maximum(whole - 2 * hi.astype(np.float64), 0)) - slack)
                    need = ((nearest[i][:, None] <= far) & (farthest[i][:, None] >= near)).any(1)
                    if seed:
                        typical = np.hypot(d[i], (a + b) / 2)
                        aim = nearest[i] if same else np.abs(typical - near.max(initial=0))
                        need_at = np.flatnonzero(need)
                        picked = need_at[[int(aim[need_at].argmin())]] if len(need_at) else need_at
                        ring_of[row] = picked[0] if len(picked) else -1
                    else:
                        need[done[row]] &= done[row] < 0
                        picked = np.flatnonzero(need)
                    out[row] = [x for k in picked.tolist() for x in range(first[k], first[k + 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ring_of), pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:6], "done", "blocks"])

    return run


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact; beyond 64 bits the nearest long."""
    x, y = q.astype(np.float64), v.astype(np.float64)
    if math.sqrt((x * x).sum(1).max(initial=0)) * math.sqrt((y * y).sum(1).max(initial=0)) < 2**52:
        return (x @ y.T).astype(np.int64)
    return np.array([[min(max(sum(map(int.__mul__, a, b)), LONG.min), LONG.max) for b in v.tolist()] for a in q.tolist()], np.int64).reshape(len(q), len(v))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 8 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return keep[np.lexsort((ids[keep], ~score[keep]))[:k]]
    return np.lexsort((ids, ~score))[:k]


def _searched(k: int, same: bool):
    """Units come one after the other, each its block's rows by distance and then its anchors: a block is held, anchors stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], {}

        def ready() -> dict:
            out: dict[int, list] = {}
            for part in held:
                for rows, v in _by_width(part.column(4)):
                    out.setdefault(v.shape[1], []).append((part.column(2).to_numpy()[rows], part.column(3).to_numpy()[rows], v))
            return {w: tuple(np.concatenate([x[i] for x in parts]) for i in range(3)) for w, parts in out.items()}

        for batch in batches:
            unit, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.diff(unit, prepend=unit[:1] - 1) | np.diff(kind, prepend=kind[:1]))
            starts = np.unique(np.concatenate([[0], starts]))
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(int(s), int(e - s))
                if unit[s] != now:
                    now, held, block = unit[s], [], None
                if kind[s] == 0:
                    held.append(part)
                    continue
                if block is None:
                    block, held = ready(), []
                found = []
                for at in range(0, part.num_rows, ANCHORS_AT_ONCE):
                    some = part.slice(at, ANCHORS_AT_ONCE)
                    name, label = some.column(2).to_numpy(), some.column(3).to_numpy()
                    low, high = some.column(5).to_pylist(), some.column(6).to_pylist()
                    for rows, q in _by_width(some.column(4)):
                        if q.shape[1] not in block:
                            continue
                        ids, labels, v = block[q.shape[1]]
                        scores = products(q, v)
                        for i, r in enumerate(rows.tolist()):
                            mine = np.flatnonzero((labels == label[r]) & (ids != name[r]) if same else labels != label[r])
                            s_, c_ = scores[i][mine], ids[mine]
                            for slot, (lo, hi) in enumerate(zip(low[r], high[r], strict=True)):
                                ok = np.flatnonzero((s_ >= lo) & (s_ <= hi))
                                top = ok[_first(s_[ok], c_[ok], k)]
                                found += [(name[r], slot, c, x) for c, x in zip(c_[top].tolist(), s_[top].tolist(), strict=True)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), FOUND.types, strict=True)], schema=FOUND)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


ANCHOR = "anchor_id long, label int, v array<long>, norm2 double, low array<long>, high array<long>"


def _search(index: Index, anchors: DataFrame, k: int, same: bool, chunks: int, label: str) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): each slot's first ``k``. ``anchors``: anchor_id, label, v, norm2, low, high."""
    groups = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.placed().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rows = rows.select((F.col("block") * chunks + F.col("chunk")).alias("unit"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "v", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"), "distance")

    def scan(routed: DataFrame) -> DataFrame:
        q = routed.withColumn("block", F.explode("blocks"))
        q = q.select((F.col("block") * chunks + F.pmod(F.xxhash64("anchor_id"), F.lit(chunks))).alias("unit"), F.lit(1).alias("kind"), F.col("anchor_id").alias("id"), "label", "v", "low", "high", F.lit(0.0).alias("distance"))
        dealt = rows.union(q).repartition(groups, "unit").sortWithinPartitions("unit", "kind", "distance", "id").drop("distance")
        return dealt.mapInArrow(_searched(k, same), FOUND_DDL)

    def route(d: DataFrame, seed: bool) -> DataFrame:
        return d.mapInArrow(_routed(index.pivots, index.rings, index.first, same, seed), f"{ANCHOR}, done int, blocks array<long>")

    seeds = route(anchors.withColumn("done", F.lit(-1)), True)
    if len(index.rings) == 1:
        return _top(scan(seeds), k)
    found = cut(_top(scan(seeds), k), f"{label}-seed")
    # a slot with k finds is open from its last one on
    floor = found.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floor"))
    low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floor", i), x)))
    rest = seeds.join(floor, "anchor_id", "left").select("anchor_id", "label", "v", "norm2", low.alias("low"), "high", "done")
    return _top(scan(route(rest, False)).union(found.select("anchor_id", "slot", "vec_id", "score")), k)


def mine_negatives(
    vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, k: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``n_positives`` other rows of its label, the first ``k`` rows of other labels whose score is from ``low_percent`` to
    ``high_percent`` of the positive's. ``anchors`` has rows of ``vectors``, with the same columns."""

    def labelled(d: DataFrame) -> DataFrame:
        x = d.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL")
        v = integer_vectors(x, "vec_id", "x", scale, "label")
        return v.select("vec_id", "label", "v", "norm2")

    spark = vectors.sparkSession
    chosen = labelled(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm2")).alias("r")).select(F.col("vec_id").alias("anchor_id"), "r.*")
    chosen = cut(chosen, "anchors")
    chunks = max(1, -(-chosen.count() // ANCHOR_CHUNK))
    rows = cut(reduced(labelled(vectors), max(n_positives + 1, k)), "vectors")
    index = Index(rows)
    drop_cut(rows)
    if not index.rings:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    any_ = chosen.withColumn("low", F.array(F.lit(LONG.min))).withColumn("high", F.array(F.lit(LONG.max)))
    positives = cut(_search(index, any_, n_positives, True, chunks, "positives"), "positives")
    # percentages of a score, inwards to whole numbers; a negative score has nothing between
    s = F.col("score").cast("decimal(20,0)")
    bounds = F.struct(F.col("rank").alias("n"), F.ceil(s * low_percent / 100).cast("long").alias("low"), F.floor(s * high_percent / 100).cast("long").alias("high"))
    slots = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(bounds)).alias("b"))  # n_positives at most
    open_ = chosen.join(slots, "anchor_id").select("anchor_id", "label", "v", "norm2", F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    found = _search(index, open_, k, False, chunks, "negatives").withColumnRenamed("rank", "place")
    p = positives.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(p, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
