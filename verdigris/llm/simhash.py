"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; bit k is the majority of bit k over the XXH64 hashes of a text's word shingles. To link
fingerprints that differ in at most three bits, each is cut into three segments that fit the perfect (23,12) Golay
code. Of the three error counts two are at most one, so for some pair (i, j) of segments both differ in one bit at
most. One fingerprint looks in segment i under every codeword near it (its own and those of all words one bit away)
and in segment j under its own codeword; the other does it the other way round. Two fingerprints with at most one
error in i and in j then share a key of 24 bits, and an equality join with a verified distance finds the link.

Equal fingerprints are one node, however many documents share it; documents are never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, key_and_text, per_batch, rows_of
from .components import components

SEED = 42
#: (lowest bit, bits) of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR = 0b110001110101


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, A-Z lower-cased, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch):
        fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
        yield rows_of(FP, {"doc_id": batch.column(0), "fp": fp.view(np.int64)})

    return key_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), "doc_id long, fp long")


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 12 information bits' words, and the error of least weight for every syndrome."""
    rest = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    one = 1 << np.arange(23)
    errors = [0, *one.tolist(), *[a | b for i, a in enumerate(one.tolist()) for b in one.tolist()[:i]]]
    errors += [a | b | c for i, a in enumerate(one.tolist()) for j, b in enumerate(one.tolist()[:i]) for c in one.tolist()[:j]]
    errors = np.array(errors, np.int64)
    table = np.zeros(1 << 11, np.int64)
    table[rest[errors >> 11] ^ (errors & 0x7FF)] = errors  # perfect: each syndrome once
    return rest, table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    rest, table = golay_tables()
    return (words ^ table[rest[words >> 11] ^ (words & 0x7FF)]) >> 11


KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
KEYS_DDL = "key long, fp long"


def lane_keys(fp: np.ndarray, looking: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions in ``fp``) of signed fingerprints: pair and two codeword indices in 26 bits.

    ``looking``: which of a pair's segments is looked up under all codewords nearby.
    """
    seg = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << n) - 1) for low, n in SEGMENTS]
    own = [codeword_index(s) for s in seg]
    near = []
    for s, (_, n) in zip(seg, SEGMENTS, strict=True):
        k = np.sort(codeword_index(s[:, None] ^ np.concatenate(([0], 1 << np.arange(n)))[None, :]), axis=1)
        first = np.ones(k.shape, bool)
        first[:, 1:] = k[:, 1:] != k[:, :-1]
        near.append((np.nonzero(first)[0], k[first]))
    keys, rows = [], []
    for p, (i, j) in enumerate(PAIRS):
        row, k = near[(i, j)[looking]]
        keys.append((p << 24) | ((k << 12) | own[j][row] if looking == 0 else (own[i][row] << 12) | k))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keys(looking: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1 << 14):
            fp = batch.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False)
            key, row = lane_keys(fp, looking)
            yield rows_of(KEYS, {"key": key, "fp": fp[row]})

    return per_batch(run)


def fingerprint_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) for all pairs of different fingerprints within ``distance`` bits, 3 at most. ``fps``: distinct fp."""
    if not 0 <= distance <= 3:
        raise ValueError("the three segments find up to three differing bits")
    left = fps.mapInArrow(_keys(0), KEYS_DDL).withColumnRenamed("fp", "a")
    right = fps.mapInArrow(_keys(1), KEYS_DDL).withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Texts with fewer words than a shingle are one shingle; texts without words, empty and null texts have fingerprint
    zero, which links like any other. Repeated rows give a row each. A null doc_id stays null and names no component;
    a component of such rows alone has none. Ties don't arise: the id is the least one that links reach.
    """
    fp = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), distance))
    of_node = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_node = cut(of_node, "roots")
    least = cut(of_node.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    label = cut(of_node.join(least, "root").select(F.col("fp").alias("node"), "component_id"), "labels")
    out = fp.join(label, fp["fp"] == label["node"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Derives further hash functions from XXH64: the golden ratio's bits.
STEP = 0x9E3779B97F4A7C15
#: Fingerprints of a text's different words, each from a hash function of its own, and the bits of all of them.
LANES = 3
#: Rows of a key are near if these fingerprints together differ in no more than this share of the bits, the fingerprints of
#: their shingles in no more than so many bits (pairs of similarity 0.8 differ in 10, give or take 3), and their sizes allow the similarity.
LOOSE = 0.35
SHINGLE_BITS = 22
#: Keys of a text, and the least shingle hashes in each: a pair of similarity s shares a key with chance 1 - (1 - s^4)^20, at
#: 0.8 all but 3 in 100,000. Texts without a common shingle share none, so keys don't fill up as the table grows.
BANDS, BAND = 20, 4
#: What a text's leading shingles have beyond the fewest that similar texts need to share one, as a share of all.
BEYOND = 0.1
WORD_COLUMNS = [f"w{i}" for i in range(LANES)]
FEATURES = [*WORD_COLUMNS, "shape", "size"]


def mixed(h: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Another hash function of what ``h`` are hashes of."""
    h = h ^ step
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


STEPS = np.arange(1, max(LANES, BANDS * BAND) + 1, dtype=np.uint64) * np.uint64(STEP)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` signed keys, each a hash of the least values of ``BAND`` hash functions over all shingles; none without shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    steps = STEPS[: BANDS * BAND, None]
    least = np.min([mixed(shingles[None, at : at + 512], steps).min(1) for at in range(0, len(shingles), 512)], axis=0).reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least)], np.uint64).view(np.int64)


def majority(hashes: np.ndarray, lanes: int) -> list[int]:
    """``lanes`` signed fingerprints from as many hash functions of the same features; zeros without features."""
    out = []
    for lane in range(lanes):
        h = mixed(hashes, STEPS[lane - 1]) if lane else hashes
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big", signed=True) if len(h) else 0)
    return out


def leading(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """The least of a text's different shingle hashes, which are sorted. ``fewest_shared`` tells what similar texts share of them."""
    n = len(shingles)
    need = math.ceil(n * similarity - 1e-9)
    return shingles[: n - need + min(1 + int(n * BEYOND), need)].view(np.int64)


def fewest_shared(size: Column, similarity: float) -> Column:
    """Leading shingles that a text of ``size`` has in common with any similar one, at least.

    Similar texts of n and m shingles, n <= m, share s * m or more. Of n the first n - s * n + b(n) are taken, so that b(n) of
    the shared ones are among them, by the common order, and among the m's as well, as b doesn't fall. A text's least similar
    partner has s * n shingles, hence b(s * n).
    """
    least = F.ceil(size * similarity - 1e-9)
    return F.least(1 + F.floor(least * BEYOND), F.ceil(least * similarity - 1e-9))


SIGNATURE_DDL = "doc_id long, h long, digest binary, keys array<long>, first array<long>, " + ", ".join(f"{w} long" for w in FEATURES)
SIGNATURE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), *[(w, pa.int64()) for w in FEATURES]])


def signatures(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """A 128-bit digest of each text's words, null without words; keys by its different shingles, and the leading ones; fingerprints
    of its different words; fingerprint and number of its different shingles. ``docs``: doc_id, h, text."""

    def run(batch: pa.RecordBatch):
        digest, keys, first, fps = [], [], [], []
        for t in batch.column(2):
            text = t.as_py()
            parts = text.encode("utf-8", "surrogatepass").lower().split()
            digest.append(xxhash.xxh3_128_digest(b" ".join(parts)) if parts else None)
            different = {xxhash.xxh64_intdigest(w, SEED) for w in dict.fromkeys(parts)}
            shingles = np.unique(shingle_hashes(text, words))
            keys.append(band_keys(shingles))
            first.append(leading(shingles, similarity))
            fps.append([*majority(np.fromiter(different, np.uint64, len(different)), LANES), *majority(shingles, 1), len(shingles)])
        lanes = dict(zip(FEATURES, zip(*fps, strict=True), strict=True))
        yield rows_of(SIGNATURE, {"doc_id": batch.column(0), "h": batch.column(1), "digest": digest, "keys": keys, "first": first, **lanes})

    return docs.select("doc_id", "h", "text").mapInArrow(per_batch(run), SIGNATURE_DDL)


def _near(a, b, similarity: float):
    """Whether two rows are near; ``a`` and ``b`` give a column by its name."""
    bits = [F.bit_count(a(w).bitwiseXOR(b(w))) for w in [*WORD_COLUMNS, "shape"]]
    sizes = F.least(a("size"), b("size")) >= similarity * F.greatest(a("size"), b("size")) - 1e-9
    return sizes & (bits[-1] <= SHINGLE_BITS) & (reduce(lambda x, y: x + y, bits[:-1]) <= int(64 * LANES * LOOSE))


def _either(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): hashes of the different shingles of each node's text.

    ``docs``: doc_id, h, text. ``nodes``: node, doc_id, h; the last two name a row that has the node's text.
    """
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
            yield rows_of(schema, {"node": part.column(0), "shingles": sets})

    wanted = nodes.select("node", F.col("doc_id").alias("n_id"), F.col("h").alias("n_h"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("h") == F.col("n_h"))).select("node", "text")
    sets = texts.mapInArrow(per_batch(run), "node long, shingles array<long>")
    return sets.groupBy("node").agg(F.min("shingles").alias("shingles"))


def verified(proposed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``proposed`` whose shingle sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("f")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("g"))
    both = proposed.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("f", "g")))
    return both.where(F.col("common") >= similarity * (F.size("f") + F.size("g") - F.col("common"))).select("a", "b")


def candidate_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """All (a, b) of different labels that may be similar, by prefixes. ``sets``: node, label, shingles.

    Shingles are ordered from the rarest on. Two similar sets share a shingle among the first of each, and from its
    places there follows how many they can share at all. Within a shingle, rows of its commonest label aren't held
    against each other, so what a large component shares costs nothing.
    """
    each = sets.select("node", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df"))
    ordered = each.join(often, "token").groupBy("node", "label", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    need = F.ceil(F.col("size") * F.lit(similarity) - 1e-9)
    first = F.slice("tokens", F.lit(1), (F.col("size") - need + 1).cast("int"))
    rows = ordered.select("node", "label", "size", F.posexplode(first).alias("pos", "t")).where("t.df > 1").select("t.token", "node", "label", "size", "pos")
    rows = cut(rows, "prefixes")
    of_label = rows.groupBy("token", "label").agg(F.count("*").alias("n"))
    mixed = of_label.groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("token", F.col("most.label").alias("commonest"))
    rows = rows.join(mixed, "token")
    left = rows.where("label <> commonest").select("token", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("size").alias("x_size"), F.col("pos").alias("x_pos"))
    right = rows.select("token", F.col("node").alias("y"), F.col("label").alias("y_label"), F.col("size").alias("y_size"), F.col("pos").alias("y_pos"))
    can_share = 1 + F.least(F.col("x_size") - F.col("x_pos") - 1, F.col("y_size") - F.col("y_pos") - 1)
    enough = can_share >= similarity / (1 + similarity) * (F.col("x_size") + F.col("y_size")) - 1e-9
    pairs = left.join(right, (left["token"] == right["token"]) & (F.col("x_label") != F.col("y_label")) & enough)
    return pairs.select(*_either("x", "y")).distinct()


def open_nodes(nodes: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """The nodes that may be similar to one of another label, all of them: ``fewest_shared`` leading shingles or more occur under
    several labels. ``nodes``: node, size, first. ``labels``: node, root; a node without is its own label."""
    labelled = nodes.select("node", "first").join(labels, "node", "left").select(F.coalesce("root", "node").alias("label"), F.explode("first").alias("token"))
    spread = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    shared = nodes.select("node", F.explode("first").alias("token")).join(spread, "token", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    return shared.join(nodes.select("node", "size"), "node").where(F.col("n") >= fewest_shared(F.col("size"), similarity)).select("node")


def similar_links(nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) that connect similar nodes. ``nodes``: node, doc_id, h, features. ``docs``: doc_id, h, text.

    1. The least hashes of the texts' shingles give keys, so that only texts with common shingles meet, however many there are.
       Each key has a leader, the row whose fingerprints most nodes have: in a group of edited copies that is the text
       they were made from. Rows near their leaders by fingerprints are proposed with them, verified, and joined into components.
    2. What the leaders didn't show is searched for among all nodes: those whose leading shingles rule out no similar node of
       another component (``open_nodes``) are held against each other by ``candidate_pairs``, and all pairs are verified.

    The first step is there for speed: large groups become one component. The second misses no pair, so all pairs with the
    wanted Jaccard similarity of shingle sets are connected, and only those.

    Nothing is gathered by key; leaders are maxima, aggregated before they are shuffled.
    """
    keys = nodes.select(F.explode("keys").alias("key"), "node")
    lanes = nodes.select("node", F.posexplode(F.array(*WORD_COLUMNS)).alias("lane", "fp"))
    popular = lanes.join(lanes.groupBy("lane", "fp").agg(F.count("*").alias("n")), ["lane", "fp"]).groupBy("node").agg(F.sum("n").alias("score"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = cut(keys.join(shared, "key").join(nodes.select("node", *FEATURES).join(popular, "node"), "node"), "runs")

    leaders = rows.groupBy("key").agg(F.max(F.struct("score", "node", *FEATURES)).alias("l"))
    close = _near(F.col, lambda w: F.col(f"l.{w}"), similarity)
    led = rows.join(leaders, "key").where((F.col("node") != F.col("l.node")) & close).select("node", F.col("l.node").alias("leader"))
    proposed = cut(led.select(*_either("node", "leader")).distinct(), "proposed")
    drop_cut(rows)
    wanted = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(shingle_sets(docs, nodes.join(wanted, "node", "left_semi"), words), "shingles")
    links = cut(verified(proposed, sets, similarity), "similar")
    drop_cut(sets)

    labels = cut(components(links), "labels")
    more = cut(open_nodes(nodes, labels, similarity), "open")
    named = nodes.join(more, "node", "left_semi")
    sets = shingle_sets(docs, named, words).join(labels, "node", "left").select("node", "shingles", F.coalesce("root", "node").alias("label"))
    sets = cut(sets, "shingles")
    again = cut(candidate_pairs(sets, similarity).join(proposed, ["a", "b"], "left_anti"), "candidates")
    rest = cut(verified(again, sets, similarity), "similar")
    for old in (labels, more, sets, proposed, again):
        drop_cut(old)
    return links.union(rest)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the least id, null ids last.

    Documents with the same words in the same order, A-Z in either case, are one node; a 128-bit digest tells. Nodes
    link as ``similar_links`` says. Null texts and texts without words are no duplicates of anything and stay. Ids need
    not be unique: rows of one id with different texts are different documents; of rows with equal id and text one stays.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    row = row.select("row", F.col("row").getField(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    plain = row.select("doc_id", "h", "text")
    sig = cut(signatures(plain, words, similarity).where("digest IS NOT NULL"), "signatures")
    # null ids last, then the least id
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = sig.groupBy("digest").agg(F.min(place).alias("p"), *[F.first(w).alias(w) for w in ("keys", "first", *FEATURES)])
    nodes = cut(least.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("p.doc_id").alias("doc_id"), F.col("p.h").alias("h"), "keys", "first", *FEATURES), "nodes")
    ids = cut(sig.groupBy("doc_id", "h").agg(F.count("*").alias("n")), "ids")
    drop_cut(sig)
    roots = cut(components(similar_links(nodes, plain, words, similarity)), "roots")
    grouped = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h").alias("p"))
    stays = grouped.groupBy("root").agg(F.min("p").alias("p")).select(F.col("p.doc_id").alias("k_id"), F.col("p.h").alias("k_h"))
    stays = cut(stays, "stays")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
    # one look-up of the rows that go or are there more than once: the texts move once at most
    marked = ids.join(stays.withColumn("stays", F.lit(True)), same, "left").select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), F.col("stays").isNull().alias("gone"), (F.col("n") > 1).alias("twice"))
    marked = cut(marked.where("gone OR twice"), "marked")
    found = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h"))
    kept = row.join(marked, found, "left").where("gone IS NULL OR NOT gone")
    one = Window.partitionBy("doc_id", "h").orderBy(F.xxhash64("row"))
    first = kept.where("twice").withColumn("n", F.row_number().over(one)).where("n = 1")
    out = kept.where("twice IS NULL").select("row").union(first.select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
