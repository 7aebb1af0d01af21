"""The prefix trie of rebuilt conversations, from mergeable partial tries.

A node is known by its depth and a 128-bit hash of the turns that lead to it: the sum of two random 64-bit numbers of each
turn (from its SHA-256) times powers of two odd bases. Such sums add up over partitions, and what is cut off the front of a
conversation can be taken away again, so a conversation's turns need no place where they all meet, and texts are never
shuffled. Node tables are combined in each task, merged by hash keys and a salt, then by hash keys alone: members are
counted, the smallest is kept, and lists of ends are joined in sorted pieces, which are hashed as a stream.

Bottom-up: nodes whose smallest member is the same lie on one chain of falling prefixes. Sums of chains are rolled up their
tree by doubling the distance of each round's ancestor, in as many rounds as the height of that tree has binary digits;
within a chain they are running sums from its lower end.

Null roles and texts are empty. Turns go by number, nulls first; turns of equal number by the SHA-256 of role and text.
Repeated rows are turns each. Rows without a conversation id take no part; an empty table gives no rows. Conversations and
texts of any length are taken whole. Other columns stay behind, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .scan import WORD, running

#: The bases of both lanes: odd, not near each other, each of the greatest order there is.
BASES = {"d0": 0x9E3779B97F4A7C15, "d1": 0xD1B54A32D192ED03}
HEADS = 3
SALTS = 16
#: Conversation ids in a piece of a list of ends.
PIECE = 100_000
KEY = ("depth", "d0", "d1")
WORDS = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda at: F.expr(f"cast(conv(substring(digest, {at}, 16), 16, -10) as bigint)")
    d = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return d.where("conv_id IS NOT NULL").select("conv_id", "turn", "digest", "words", lane(1).alias("d0"), lane(17).alias("d1"))


def _head(c: str, n: int) -> Column:
    return F.max(F.when(F.col("n") == n, F.struct("d0", "d1", "words"))).alias(c)


def rebuilt(ordered: DataFrame, group: int, most: int) -> DataFrame:
    """A row per conversation: how many of its own turns go (``h``), how many heads come before the rest (``m``), the hashes of both, and the heads."""
    c = cut(ordered.groupBy("conv_id").agg(F.max("n").alias("n_turns"), *[_head(f"head{i}", i) for i in range(1, most)]), "conversations")
    base = c.select(F.col("conv_id").alias("base_id"), F.col("n_turns").alias("base_turns"), F.array(*[f"head{i}" for i in range(1, most)]).alias("heads"))
    own = c.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    d = own.join(base, "base_id", "left").withColumn("m", F.least("h", F.coalesce("base_turns", F.lit(0)).cast("int")))
    d = d.withColumn("heads", F.slice(F.coalesce("heads", F.array().cast(base.schema["heads"].dataType)), F.lit(1), F.col("m")))
    nothing = F.struct(F.lit(0).cast("long").alias("d0"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("words"))
    gone = F.get(F.array(nothing, *[f"head{i}" for i in range(1, most)]), F.least(F.col("h").cast("long"), F.col("n_turns")).cast("int"))
    start = F.coalesce(F.get("heads", F.col("m") - 1), nothing)
    length = F.col("m") + F.greatest(F.lit(0), F.col("n_turns") - F.col("h"))
    out = d.select("conv_id", "n_turns", "h", "m", length.cast("long").alias("length"), "heads", start["d0"].alias("s0"), start["d1"].alias("s1"), gone["d0"].alias("g0"), gone["d1"].alias("g1"))
    return cut(out, "rebuilt")


MEMBER_DDL = "depth long, d0 long, d1 long, p0 long, p1 long, conv_id long, words long, ends boolean"


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a conversation's own prefixes become those of the rebuilt one's: its heads' hash, and the rest moved to its new places."""
    for b in batches:
        col = {c: b.column(c).to_numpy() for c in b.schema.names}
        shift = (col["h"] - col["m"]).astype(np.int64)
        out = {}
        for lane, (base, name) in enumerate(zip(BASES.values(), BASES, strict=True)):
            back = pow(base, -1, WORD)
            factor = np.array([pow(back, i, WORD) for i in range(int(shift.max(initial=0)) + 1)], np.uint64)[shift]
            start, gone = col[f"s{lane}"].astype(np.int64).view(np.uint64), col[f"g{lane}"].astype(np.int64).view(np.uint64)
            for to, x in ((f"d{lane}", name), (f"p{lane}", f"{name}_before")):
                out[to] = pa.array((start + (col[x].astype(np.int64).view(np.uint64) - gone) * factor).view(np.int64))
        depth = col["n"] - shift
        columns = [pa.array(depth), out["d0"], out["d1"], out["p0"], out["p1"], b.column("conv_id"), b.column("words"), pa.array(depth == col["length"])]
        yield pa.RecordBatch.from_arrays(columns, names=["depth", "d0", "d1", "p0", "p1", "conv_id", "words", "ends"])


def members(ordered: DataFrame, info: DataFrame) -> DataFrame:
    """A row for each conversation and each of its prefixes: the node, its parent, and whether the conversation ends there."""
    own = ordered.join(info.drop("heads"), "conv_id").where("n > h").select("conv_id", "n", "words", *BASES, *[f"{x}_before" for x in BASES], "h", "m", "length", "s0", "s1", "g0", "g1")
    zero = F.lit(0).cast("long")
    heads = info.select("conv_id", "length", "heads", F.posexplode("heads").alias("i", "x")).withColumn("up", F.get("heads", F.col("i") - 1))
    depth = F.col("i") + 1
    heads = heads.select(depth.cast("long").alias("depth"), "x.d0", "x.d1", F.coalesce("up.d0", zero).alias("p0"), F.coalesce("up.d1", zero).alias("p1"), "conv_id", "x.words", (depth == F.col("length")).alias("ends"))
    root = info.select(zero.alias("depth"), zero.alias("d0"), zero.alias("d1"), zero.alias("p0"), zero.alias("p1"), "conv_id", zero.alias("words"), (F.col("length") == 0).alias("ends"))
    return own.mapInArrow(_moved, MEMBER_DDL).unionByName(heads).unionByName(root)


def merged(rows: DataFrame) -> DataFrame:
    """The node table. Spark combines in each task before either merge, so a node has a row per task and salt at most, then one per salt."""
    rest = [F.min(c).alias(c) for c in ("conv_id", "p0", "p1", "words")]
    part = rows.groupBy(*KEY, F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n_convs"), *rest)
    return part.groupBy(*KEY).agg(F.sum("n_convs").alias("n_convs"), *rest)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first id, ids as text) of sorted (node, id)."""
    now, ids = None, []
    out: list[tuple] = []

    def close() -> None:
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=[*KEY, "first", "ids"])
        out.clear()
        return done

    for b in batches:
        for *key, i in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if key != now or len(ids) == PIECE:
                close()
                now = key
            ids.append(i)
        if len(out) >= 10_000 or sum(len(x[-1]) for x in out) > 1 << 24:
            yield batch()
    close()
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come in order."""
    now, sha = None, None
    for b in chain(batches, [None]):
        out = []
        for *key, ids in zip(*[c.to_pylist() for c in b.columns], strict=True) if b is not None else [(None, "")]:
            if key != now:
                if sha is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])


def end_hashes(rows: DataFrame) -> DataFrame:
    ends = rows.where("ends").select(*KEY, "conv_id")
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces, "depth long, d0 long, d1 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").drop("first").mapInArrow(_hashed, "depth long, d0 long, d1 long, ends_sha256 string")


def chain_sums(linked: DataFrame, root_id: int) -> DataFrame:
    """(conv_id, up, at, leaves, saved): each chain's sums with all chains below it; it hangs on chain ``up`` at depth ``at``."""
    head = F.min(F.struct("depth", "parent_conv_id"))
    own = linked.groupBy("conv_id").agg(head.alias("head"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    now = cut(own.select("conv_id", F.col("head.parent_conv_id").alias("up"), (F.col("head.depth") - 1).alias("at"), "leaves", "saved", F.col("head.parent_conv_id").alias("far")), "chains")
    while not now.where("far IS NOT NULL").isEmpty():
        below = now.where("far IS NOT NULL").groupBy(F.col("far").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        # what hangs on the root's chain is as far up as it goes
        farther = now.where(F.col("far") != root_id).select("conv_id", "far").join(now.select(F.col("conv_id").alias("far"), F.col("far").alias("farther")), "far").select("conv_id", "farther")
        new = now.join(below, "conv_id", "left").join(farther, "conv_id", "left")
        new = new.select("conv_id", "up", "at", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("farther").alias("far"))
        before, now = now, cut(new, "chains")
        drop_cut(before)
    return now


def prefix_trie(
    conversations: DataFrame, group: int = 20, most: int = HEADS + 1, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node. Every conversation c is rebuilt first: up to crc32(c) % ``most`` turns of conversation c - c % ``group``, then
    its own without as many."""
    ordered = running(turns(conversations, id_col, turn_col, role_col, text_col), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], BASES, "turns")
    info = rebuilt(ordered, group, most)
    rows = cut(members(ordered, info), "members")
    drop_cut(ordered)
    nodes = cut(merged(rows), "nodes")
    root = nodes.where("depth = 0").select("conv_id").first()
    root_id = root["conv_id"] if root else None
    up = [(F.col("depth") - 1).alias("depth"), F.col("p0").alias("d0"), F.col("p1").alias("d1")]
    kids = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("d0").alias("p0"), F.col("d1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above, ["depth", "p0", "p1"], "left")
    flat = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_id).cast("long")))
    linked = deep.unionByName(flat).join(kids, list(KEY), "left").join(end_hashes(rows), list(KEY), "left")
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    none = hashlib.sha256(b"").hexdigest()
    linked = linked.select("conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    linked = cut(linked, "linked")
    drop_cut(rows)
    drop_cut(nodes)
    hung = chain_sums(linked, root_id).where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    whole = linked.join(hung, ["conv_id", "depth"], "left")
    whole = whole.withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaves", "more_saved")
    out = running(whole, "conv_id", [F.desc("depth")], {"leaves": 1, "saved": 1}, "rollup")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
