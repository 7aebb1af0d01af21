"""Exact removal of repeated byte strings with a sparse, distributed suffix array.

Every byte covered by a ``length``-byte string that also starts elsewhere goes. Suffixes are kept at anchors only: the
least-hashing position of every window of ``length`` bytes, by its ``LEAD`` leading bytes. Equal windows have their
anchor at the same place, so any repeated string is found from the anchors inside it, and about one position in
seventy has one.

1. Documents are numbered and written, compressed. Their anchor suffixes are range-partitioned by leading bytes
   between splitters, which the suffixes of some sampled documents give, so that all others are computed once, and sorted
   in each range: by the first eight bytes, a hash of the ``LEAD`` leading ones, and the first window that holds the
   anchor. Neighbours are compared as they stream by. Suffixes with
   equal leading bytes may span several ranges; one at the edge of a range counts as having a neighbour, which the
   counts of step 2 confirm or refute. What has a neighbour is sorted once more by the last window. An anchor whose first
   and last windows both recur is settled, and so is one whose leading bytes nobody shares. Equal suffixes of one
   task are first merged into one that stands for many.
2. Runs of equal leading bytes with an unsettled anchor send the bytes around one anchor of each different context. All
   windows of a run are sorted by their bytes, by multikey quicksort with eight bytes as one key, and equal
   neighbours recur, which settles each anchor's leftmost and rightmost repeated window. A run with over ``WIDE_RUN``
   contexts would be too much for a task; its windows go one by one through an aggregation that Spark can split.
3. Each document unites its intervals and drops them.

Step 1 tells windows by two 64-bit hashes, of leading bytes and window. Null and empty texts have no bytes; texts shorter
than ``length`` are kept whole; strings never cross documents; repeated rows are documents of their own, so their
strings recur. Very long texts go slab by slab.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import cut, key_and_text, per_batch

LEAD = 64
FLUSH = 1_000_000
SEED = 42
WIDE_RUN = 16_384
CHUNK = 4096
#: Splitters come from the suffixes of about so many documents a range, and from no more than so many suffixes a range.
SAMPLED_DOCS, SAMPLED_SUFFIXES = 32, 256
#: Positions of a slab of a very long document fit into so many bits.
POS_BITS = 24
SLAB = 1 << 23
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
LOW = np.uint64((1 << POS_BITS) - 1)
TOP = np.uint64(1 << 63)
FIRST, LAST, ASKED, IN_RUN = 1, 2, 4, 8


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * M2
    x += b
    x ^= x >> np.uint64(29)
    x *= M3
    x ^= x >> np.uint64(32)
    return x


def lead_hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the LEAD bytes from every position, along the last axis; halves are joined by doubling."""
    h = (a.astype(np.uint64) + np.uint64(1)) * M1
    size = 1
    while size < LEAD:
        h = _mix(h[..., :-size], h[..., size:])
        size *= 2
    return h


def window_hashes(lead: np.ndarray, at, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from ``at``, from the lead hashes that cover them."""
    steps = [*range(0, length - LEAD, LEAD), length - LEAD]
    x = lead[..., at]
    for s in steps[1:]:
        x = _mix(x, lead[..., at + s])
    return x


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(positions, first eight bytes as ordered longs, lead hashes, hashes of the first and of the last window that holds each anchor)."""
    n = len(data)
    found = []
    for at in range(0, max(0, n - length + 1), SLAB):
        base = max(0, at - length)
        a = np.frombuffer(data, np.uint8, min(n, at + SLAB + 2 * length) - base, base)
        lead = lead_hashes(a)
        key = (lead & ~LOW) | np.arange(len(lead), dtype=np.uint64)
        least = sliding_least(key, length - LEAD + 1)[at - base : at - base + SLAB]
        p = (least[np.concatenate(([True], least[1:] != least[:-1]))] & LOW).astype(np.int64)
        first, last = np.maximum(p - (length - LEAD), 0), np.minimum(p, len(a) - length)
        # an anchor's place in the window counts: at a text's end several anchors have one and the same last window
        w = [_mix(window_hashes(lead, x, length), (p - x).astype(np.uint64)) for x in (first, last)]
        head = a[p[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64) ^ TOP
        found.append((p + base, head, lead[p], *w))
    if not found:
        return np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 4
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SUFFIX = pa.schema([("head", pa.int64()), ("lead", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("kind", pa.int8())])
SUFFIX_DDL = "head long, lead long, first long, last long, row_key long, pos int, kind byte"
ONE, SETTLED, MANY = 0, 1, 2
RANGED = SUFFIX.append(pa.field("range", pa.int32()))
RANGED_DDL = SUFFIX_DDL + ", range int"


def _ordered(head: np.ndarray, lead: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte strings in the order of the three columns as signed longs."""
    return np.stack([head ^ TOP, lead ^ TOP, first ^ TOP], axis=1).astype(">u8").view("S24").ravel()


def ranges_of(head: np.ndarray, lead: np.ndarray, first: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters are at or before each suffix. ``splitters``: sorted rows of head, lead and first."""
    at = splitters[:, 0] ^ TOP
    low, high = np.searchsorted(at, head ^ TOP, "left"), np.searchsorted(at, head ^ TOP, "right")
    tied = np.flatnonzero(low < high)
    high[tied] = np.searchsorted(_ordered(*splitters.T), _ordered(head[tied], lead[tied], first[tied]), "right")
    return high.astype(np.int32)


def sampled_splitters(packed: DataFrame, length: int, ranges: int) -> np.ndarray:
    """Rows of head, lead and first that part suffixes into about equal ranges, ``ranges - 1`` at most.

    A suffix that k of the sample's tasks hold stands for k of them, but for no more than all tasks would send.
    """
    n, tasks = packed.select(F.spark_partition_id().alias("task")).agg(F.count("*"), F.max("task") + 1).first()
    share = min(1.0, SAMPLED_DOCS * ranges / n) if n else 1.0
    some = packed.sample(share, seed=SEED).select("row_key", "data").mapInArrow(_suffixes(length), RANGED_DDL)
    counted = some.groupBy("head", "lead", "first").agg(F.count("*").alias("k"))
    found = sorted(tuple(r) for r in counted.orderBy(F.xxhash64("head", "lead", "first")).limit(SAMPLED_SUFFIXES * ranges).collect())
    if not found:
        return np.zeros((0, 3), np.uint64)
    rows = np.array(found, np.int64)
    weight = np.cumsum(np.minimum(rows[:, 3], max(1.0, (tasks or 1) * share)))
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return rows[np.unique(at), :3].view(np.uint64)


def _suffixes(length: int, splitters: np.ndarray | None = None) -> Callable:
    """Anchors of documents, with their range; equal ones of a task become one of kind MANY, the others of them SETTLED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            head, lead, first, last, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((last, first, lead))
            head, lead, first, last, row, pos = (x[order] for x in (head, lead, first, last, row, pos))
            same = (lead[1:] == lead[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
            kind = np.zeros(len(lead), np.int8)
            kind[1:][same] = SETTLED
            kind[:-1][same & (kind[:-1] == ONE)] = MANY
            gone = kind == SETTLED
            head[gone] = _mix(row[gone].view(np.uint64), pos[gone].astype(np.uint64))  # spread: no comparison needs them
            lead[gone] = first[gone] = last[gone] = 0
            to = np.zeros(len(head), np.int32) if splitters is None else ranges_of(head, lead, first, splitters)
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (head, lead, first, last)), pa.array(row), pa.array(pos), pa.array(kind), pa.array(to)], schema=RANGED)

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p, *hashes = anchors(_unpacked(data.as_py()), length)
                if len(p):
                    held.append((*hashes, np.full(len(p), key), p.astype(np.int32)))
                    size += len(p)
                    if size >= FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return run


NEAR = pa.schema([*SUFFIX, pa.field("flags", pa.int8())])
NEAR_DDL = SUFFIX_DDL + ", flags byte"


def _neighbours(batches: Iterator[pa.RecordBatch], window: int, flag: int) -> Iterator[pa.RecordBatch]:
    """Suffixes that share their leading bytes with a neighbour, or stand at the range's edge, from sorted ones.

    ``window``: the column that is sorted by after the leading bytes; ``flag`` is set where a neighbour has an equal one.
    Memory is one batch: a batch's last row waits for the next batch.
    """
    wait: list[np.ndarray] | None = None

    def decide(cols: list[np.ndarray], known: bool, more: bool) -> tuple[list[np.ndarray] | None, pa.RecordBatch]:
        """Decides all rows but, if there are ``more``, the last, which waits. ``known``: the first one has waited."""
        head, lead, kind = cols[0], cols[1], cols[6]
        run = (head[1:] == head[:-1]) & (lead[1:] == lead[:-1])
        same = run & (cols[window][1:] == cols[window][:-1])
        in_run = np.concatenate(([not known], run)) | np.concatenate((run, [not more])) | (kind == MANY)
        hit = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (kind == MANY)
        flags = cols[7] | np.where(hit, flag, 0).astype(np.int8) | np.where(in_run, IN_RUN, 0).astype(np.int8)
        if flag == FIRST:  # one of equal suffixes is enough to ask about
            flags |= np.where(np.concatenate(([not known], ~(same & (cols[3][1:] == cols[3][:-1])))), ASKED, 0).astype(np.int8)
        settled = kind == SETTLED
        flags[settled] = FIRST | LAST
        out = (settled | (flags & IN_RUN > 0)) & (np.arange(len(head)) < len(head) - more)
        batch = pa.RecordBatch.from_arrays([*(pa.array(c[out]) for c in cols[:7]), pa.array(flags[out] & ~np.int8(IN_RUN))], schema=NEAR)
        return [*(c[-1:] for c in cols[:7]), flags[-1:]] if more else None, batch

    for batch in batches:
        if batch.num_rows:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if len(cols) == 8 else [*cols, np.zeros(batch.num_rows, np.int8)]
            wait, out = decide([np.concatenate(x) for x in zip(wait, cols, strict=True)] if wait else cols, wait is not None, True)
            yield out
    if wait:
        yield decide(wait, True, False)[1]


def _packed(docs: DataFrame) -> DataFrame:
    """(row_key, data, carried): numbered documents as compressed bytes, written. ``docs``: text, carried."""
    def run(batch: pa.RecordBatch):
        press = zstandard.ZstdCompressor(level=1).compress
        data = pa.array([press(b) if (b := t.as_buffer().to_pybytes()) else b"" for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), data, batch.column(2)], names=["row_key", "data", "carried"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row_key"), "text", "carried")
    return cut(numbered.mapInArrow(per_batch(run), StructType([StructField("row_key", LongType()), StructField("data", BinaryType()), docs.schema["carried"]])), "packed")


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of equal first columns, about ``rows`` rows at a time, from sorted batches of bounded runs."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= rows:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut_at = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut_at:
                yield [c[:cut_at] for c in cols]
            held = [[c[cut_at:] for c in cols]]
            size = len(cols[0]) - cut_at
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


CONTEXT_DDL = "lead long, row_key long, pos int, before int, bytes binary, window long"
CONTEXT = pa.schema([("lead", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("bytes", pa.binary()), ("window", pa.int64())])


def _contexts(length: int) -> Callable:
    """The bytes around anchors that were asked about; for very wide runs, a row per window instead."""
    side = length - LEAD

    def run(batch: pa.RecordBatch):
        for key, data, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = _unpacked(data.as_py())
            rows, wide = [], []
            for x in asked:
                p = x["pos"]
                start, stop = max(0, p - side), min(len(text), p + length)
                if x["contexts"] <= WIDE_RUN:
                    rows.append((x["lead"], key, p, p - start, text[start:stop], None))
                else:
                    h = lead_hashes(np.frombuffer(text, np.uint8, stop - start, start))
                    w = window_hashes(h, np.arange(stop - start - length + 1), length)
                    wide += [(x["lead"], key, p, p - start - k, None, v) for k, v in enumerate(w.view(np.int64).tolist())]
            for part in (rows, wide):
                for at in range(0, len(part), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part[at : at + (1 << 14)], strict=True), CONTEXT, strict=True)], schema=CONTEXT)

    return per_batch(run)


SPAN = pa.schema([("row_key", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
SPAN_DDL = "row_key long, a int, b int"


def equal_rows(group: np.ndarray, word: Callable[[np.ndarray, int], np.ndarray], words: int) -> np.ndarray:
    """Which rows have an equal one in their group, by multikey quicksort: rows are parted by one word of their bytes at a
    time, and only parts of two or more go on to the next. A part whose rows all have one word needs no sorting.
    ``group``: small integers from 0. ``word``: the k-th word of some rows."""
    out = np.zeros(len(group), bool)
    rows = np.flatnonzero(np.bincount(group)[group] > 1)
    rows = rows[np.argsort(group[rows], kind="stable")]
    part = group[rows]
    for k in range(words):
        if not len(rows):
            return out
        w = word(rows, k)
        torn = np.zeros(part[-1] + 1, bool)
        torn[part[1:][(part[1:] == part[:-1]) & (w[1:] != w[:-1])]] = True
        at = np.flatnonzero(torn[part])
        if not len(at):
            continue
        order = at[np.lexsort((w[at], part[at]))]
        rows[at], w[at] = rows[order], w[order]
        part = np.cumsum(np.concatenate(([True], (part[1:] != part[:-1]) | (w[1:] != w[:-1])))) - 1
        many = np.bincount(part)[part] > 1
        rows, part = rows[many], part[many]
    out[rows] = True
    return out


def _settle(length: int) -> Callable:
    """From contexts sorted by lead: each anchor's union of windows whose bytes recur in its run."""
    side = length - LEAD
    width = side + length
    # words of a window: from its ends inwards, as what is around equal leading bytes differs soonest
    steps = [*range(0, length - 8, 8), length - 8]
    steps = [steps[k // 2] if k % 2 == 0 else steps[-1 - k // 2] for k in range(len(steps))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lead, row, pos, before, data in _runs(batches, CHUNK):
            m = np.zeros((len(lead), width), np.uint8)
            start = side - before.astype(np.int64)
            size = np.fromiter(map(len, data), np.int64, len(data))
            for i, (s, d) in enumerate(zip(start.tolist(), data, strict=True)):
                m[i, s : s + len(d)] = np.frombuffer(d, np.uint8)
            number = np.cumsum(np.concatenate(([True], lead[1:] != lead[:-1]))) - 1
            col = np.arange(side + 1)
            whole = (col[None, :] >= start[:, None]) & (col[None, :] + length <= (start + size)[:, None])
            of, at = np.nonzero(whole)
            begin = of * width + at
            eight = np.ndarray((max(0, m.size - 7),), np.uint64, m, strides=(1,))  # from every byte on

            def word(rows: np.ndarray, k: int, begin=begin, eight=eight) -> np.ndarray:
                return eight[begin[rows] + steps[k]]

            grid = np.zeros(whole.shape, bool)
            grid[whole] = equal_rows(number[of] * (side + 1) + at, word, len(steps))
            some = np.flatnonzero(grid.any(1))
            g = grid[some]
            a = pos[some] - side + g.argmax(1)
            b = pos[some] - side + (side - g[:, ::-1].argmax(1)) + length
            yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], schema=SPAN)

    return run


def covered(n: int, spans: list, length: int) -> np.ndarray:
    """Which of ``n`` bytes go. A span is (start, end), or (anchor, -flags) for its first or last window."""
    edge = np.zeros(n + 1, np.int32)
    for x in spans:
        a, b = x["a"], x["b"]
        if b > 0:
            edge[a] += 1
            edge[b] -= 1
            continue
        if -b & FIRST:
            s = max(0, a - (length - LEAD))
            edge[s] += 1
            edge[s + length] -= 1
        if -b & LAST:
            s = min(a, n - length)
            edge[s] += 1
            edge[s + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(numbered documents as bytes, spans by their number). ``docs``: text, carried."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(docs)
    suffixes = packed.select("row_key", "data").mapInArrow(_suffixes(length, sampled_splitters(packed, length, n)), RANGED_DDL)
    by_first = suffixes.repartitionById(n, "range").drop("range").sortWithinPartitions("head", "lead", "first", "last")
    near = cut(by_first.mapInArrow(partial(_neighbours, window=2, flag=FIRST), NEAR_DDL), "suffixes")
    open_ = near.where(F.col("kind") != SETTLED)
    by_last = open_.repartitionByRange(n, "head", "lead", "last").sortWithinPartitions("head", "lead", "last")
    found = cut(by_last.mapInArrow(partial(_neighbours, window=3, flag=LAST), NEAR_DDL), "found")
    asked = F.col("flags").bitwiseAND(ASKED) > 0
    unsettled = F.col("flags").bitwiseAND(FIRST | LAST) != FIRST | LAST
    runs = found.groupBy("lead").agg(F.count_if(asked).cast("int").alias("contexts"), F.bool_or(unsettled).alias("open")).where("open AND contexts > 1").select("lead", "contexts")
    wanted = found.where(asked).select("lead", "row_key", "pos").join(runs, "lead").groupBy("row_key").agg(F.collect_set(F.struct("pos", "lead", "contexts")).alias("asked"))
    around = cut(packed.join(wanted, "row_key").select("row_key", "data", "asked").mapInArrow(_contexts(length), CONTEXT_DDL), "contexts")
    narrow = around.where(F.col("bytes").isNotNull()).select("lead", "row_key", "pos", "before", "bytes").repartition(n, "lead").sortWithinPartitions("lead")
    spans = narrow.mapInArrow(_settle(length), SPAN_DDL)
    wide = around.where(F.col("bytes").isNull()).select("lead", "window", "row_key", "pos", "before")
    twice = wide.groupBy("lead", "window").agg(F.count("*").alias("n")).where("n > 1").select("lead", "window")
    start = F.col("pos") - F.col("before")
    wide = wide.join(twice, ["lead", "window"], "left_semi").groupBy("row_key", "pos").agg(F.min(start).alias("a"), (F.max(start) + length).alias("b"))
    flags = -(F.col("flags").bitwiseAND(FIRST | LAST).cast("int"))
    plain = near.where(F.col("kind") == SETTLED).union(found).select("row_key", F.col("pos").alias("a"), flags.alias("b")).where("b < 0")
    return packed, plain.union(spans).union(wide.select("row_key", "a", "b"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(length: int) -> Callable:
    def run(batch: pa.RecordBatch):
        rows = []
        for doc, data, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = _unpacked(data.as_py())
            if not spans:
                rows.append((doc, len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            gone = covered(len(text), spans, length)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((doc, len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)

    return per_batch(run)


def _joined(packed: DataFrame, spans: DataFrame) -> DataFrame:
    by_row = spans.groupBy("row_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return packed.join(by_row, "row_key", "left")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs, and a digest of what is left."""
    d = key_and_text(docs, id_col, text_col).select("text", F.col("doc_id").alias("carried"))
    return _joined(*repeated_spans(d, length)).select("carried", "data", "spans").mapInArrow(_digest(length), OUT_DDL)


def text_left(text: bytes, gone: np.ndarray) -> str:
    """What is left of UTF-8 bytes; a character that loses any byte goes."""
    a = np.frombuffer(text, np.uint8)
    char = np.cumsum((a & 0xC0) != 0x80) - 1
    lost = np.bincount(char, gone) > 0
    return a[~lost[char]].tobytes().decode()


def drop_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the bytes that ``remove_repeats`` counts cut out of the texts. No row goes; null texts stay null."""
    text = F.col(f"`{text_col}`")
    others = [c for c in docs.columns if c != text_col]
    none = "none"
    while none.lower() in {c.lower() for c in others}:
        none += "_"
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in others], text.isNull().alias(none))
    d = docs.select(F.coalesce(text.cast("string"), F.lit("")).alias("text"), carried.alias("carried"))
    joined = _joined(*repeated_spans(d, length)).select("carried", "data", "spans")

    def run(batch: pa.RecordBatch):
        out = []
        for data, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = _unpacked(data.as_py())
            out.append(text_left(raw, covered(len(raw), spans, length)) if spans else raw.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["carried", "text"])

    left = joined.mapInArrow(per_batch(run), StructType([d.schema["carried"], StructField("text", StringType())]))
    new = F.when(~F.col("carried").getField(none), F.col("text"))
    return left.select(*[new.alias(c) if c == text_col else F.col("carried").getField(c).alias(c) for c in docs.columns])
