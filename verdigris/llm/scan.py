"""Running sums of the rows of a group in order, with no group in one task.

Rows are range-partitioned by group and order, so that a group may lie in many partitions; each partition adds up what it
has, and what earlier partitions hold of its first group is put on afterwards. The driver sees one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = 1 << 64


def signed(x: int) -> int:
    return (x + (WORD >> 1)) % WORD - (WORD >> 1)


def _local(group: str, lanes: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first, count = TaskContext.get().partitionId(), None, None, 0
        held = {x: (0, 1) for x in lanes}  # of the open group: the sum, and the power of its last row
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).to_numpy()
            first = g[0] if first is None else first
            goes_on = last is not None and g[0] == last
            starts = np.flatnonzero(np.diff(g, prepend=g[0] - 1) != 0)
            size = np.diff(starts, append=len(g))
            at = np.arange(1, len(g) + 1) - np.repeat(starts, size)
            inside = slice(0, int(size[0]) if goes_on else 0)
            n = at.copy()
            n[inside] += count
            columns = {c: b.column(c) for c in b.schema.names}
            for x, base in lanes.items():
                power = np.cumprod(np.full(int(size.max()) + 1, base, np.uint64)) if base != 1 else np.ones(int(size.max()) + 1, np.uint64)
                scale = power[at - 1]
                total, of_last = held[x] if goes_on else (0, 1)
                scale[inside] *= np.uint64(of_last)
                term = b.column(x).to_numpy().astype(np.int64).view(np.uint64) * scale
                sums = np.cumsum(term, dtype=np.uint64)
                out = sums - np.repeat(sums[starts] - term[starts], size)
                out[inside] += np.uint64(total)
                columns[x], columns[f"{x}_before"] = pa.array(out.view(np.int64)), pa.array((out - term).view(np.int64))
                held[x] = (int(out[-1]), int(scale[-1]))
            columns |= {"n": pa.array(n), "part": pa.array(np.full(len(g), part, np.int32)), "opens": pa.array(g == first)}
            last, count = g[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _carried(lanes: dict[str, int], carry: dict[int, tuple[int, dict[str, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            opens, n = b.column("opens").to_numpy(zero_copy_only=False), b.column("n").to_numpy().copy()
            columns = {c: b.column(c) for c in b.schema.names if c not in ("part", "opens")}
            part = b.column("part").to_numpy()
            for p in np.unique(part[opens]).tolist():
                if p in carry:
                    more, sums = carry[p]
                    hit = np.flatnonzero(opens & (part == p))
                    n[hit] += more
                    for x, base in lanes.items():
                        for c in (x, f"{x}_before"):
                            y = columns[c].to_numpy().copy().view(np.uint64)
                            y[hit] = y[hit] * np.uint64(pow(base, more, WORD)) + np.uint64(sums[x])
                            columns[c] = pa.array(y.view(np.int64))
            columns["n"] = pa.array(n)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def running(d: DataFrame, group: str, order: list[Column], lanes: dict[str, int], label: str) -> DataFrame:
    """``d`` with ``n``, a row's place in its group from 1; each lane (a long) becomes the sum over its group up to this row of
    lane times base to the power of place, modulo 2^64, and ``<lane>_before`` the same without this row. A base of 1 gives
    plain sums. Rows that tie in ``order`` come in any order. ``group``: a long that isn't null."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    more = "".join(f", {x}_before long" for x in lanes)
    # columns of a batch keep their place; the lanes' second halves follow, then what is told about the row
    keys = [F.col(group), *order, F.monotonically_increasing_id()]
    sorted_ = d.repartitionByRange(*keys).sortWithinPartitions(group, *order)
    local = cut(sorted_.mapInArrow(_local(group, lanes), f"{names}{more}, n long, part int, opens boolean"), label)
    each = F.struct(F.col("n"), *[F.col(x) for x in lanes])
    ends = local.groupBy("part").agg(F.min(group).alias("first"), F.max(F.when(F.col("opens"), each)).alias("opening"), F.max(F.struct(F.col(group).alias("g"), each.alias("x"))).alias("last"))
    carry: dict[int, tuple[int, dict[str, int]]] = {}
    before, n, sums = None, 0, {}
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # a row per partition
        opening, last = r["opening"], r["last"]
        own_n, own = opening["n"], {x: opening[x] % WORD for x in lanes}
        if before == r["first"]:
            carry[r["part"]] = (n, sums)
            own = {x: (sums[x] + pow(b, n, WORD) * own[x]) % WORD for x, b in lanes.items()}
            own_n += n
        if last["g"] != r["first"]:
            own_n, own = last["x"]["n"], {x: last["x"][x] % WORD for x in lanes}
        before, n, sums = last["g"], own_n, own
    out = local.mapInArrow(_carried(lanes, carry), f"{names}{more}, n long")
    out._cut_path = local._cut_path
    return out
