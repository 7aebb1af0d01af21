"""Connected components of a link table by alternating stars, all in the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

EDGE_DDL = "a long, b long"
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
FLUSH = 1_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes but the roots."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what the links of this task connect, each node to its least: at most one per node."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        x, y = _forest(np.concatenate(a), np.concatenate(b))
        a.clear()
        b.clear()
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=EDGE)

    for batch in batches:
        if batch.num_rows:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, a)) >= FLUSH:
                yield flush()
    if a:
        yield flush()


def _least_neighbour(links: DataFrame, key: str, other: str) -> DataFrame:
    return links.groupBy(F.col(key).alias("u")).agg(F.min(other).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: ``root`` is the least node that links reach. ``links``: long a, b.

    Each task first reduces its links to a forest, and where no more than ``FLUSH`` links are left, one task does so with
    all of them. Otherwise there are rounds of large and small stars; each is written to the shared folder, so that
    lineage stays short and a hub's links meet its label in a join that adaptive execution can split. Ends when a round
    changes nothing. Repeated links, links in both directions and loops do no harm; no links give no rows.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_local, EDGE_DDL)
    edges = cut(links.distinct(), "links")  # a > b
    seen = _signature(edges)
    if seen[0] <= FLUSH:  # no more than each task has held before: one task makes the last forest
        return edges.coalesce(1).mapInArrow(_local, EDGE_DDL).select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(_least_neighbour(both, "a", "b").select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large")
        low = cut(_least_neighbour(large, "a", "b"), "low")
        pairs = large.join(low, large["a"] == low["u"])
        small = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = cut(small.distinct(), "links")
        now = _signature(new)
        for old in (edges, least, large, low):
            drop_cut(old)
        edges = new
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
