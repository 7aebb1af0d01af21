import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import negatives, neighbours, scan, trie

VECTORS = "vec_id long, embedding array<float>, label int, v string, rank int, x int"


def plain_negatives(rows, anchors, n_positives=5, k=10, scale=256):
    """Every pair by Python integers; rows: (id, vector, label), equal ones once."""
    ok = {(i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in anchors:
        mine = sorted((label, v) for i, v, label in ok if i == a)
        if not mine:
            continue
        label, q = mine[0]
        scored = [(sum(x * y for x, y in zip(q, v)), i, other) for i, v, other in ok if len(v) == len(q)]  # noqa: B905
        positives = sorted((-s, i) for s, i, other in scored if other == label and i != a)[:n_positives]
        for p, j in positives:
            hits = sorted((-s, i) for s, i, other in scored if other != label and 30 * -p <= 100 * s <= 90 * -p)[:k]
            out += [(a, j, n, i, -p, -s) for n, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def mine(spark, rows, **more):
    d = spark.createDataFrame([(i, v, label, "v", 1, 2) for i, v, label in rows], VECTORS)
    return sorted(map(tuple, negatives.mine_negatives(d, d.where("vec_id % 10 = 0"), **more).collect()))


@pytest.mark.parametrize("block", [8192, 40])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * 0.4 + rng.normal(size=8) * 0.3).tolist(), int(i % 4)) for i in range(400)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, i % 2) for i in range(200)]  # a hot vector, of two labels
    rows += [(2000, hot, 1)] * 30 + [(20, rows[20][1], 3), (30, hot, 2)]  # repeats, and ids with two vectors or labels
    rows += [(3000, None, 1), (3001, [1.0, None] * 4, 1), (3002, [float("nan")] * 8, 1), (3003, [1.0] * 8, None), (None, [1.0] * 8, 1), (3010, [0.0] * 8, 2), (3020, [0.5] * 3, 1), (3021, [0.4] * 3, 1), (3022, [0.3] * 3, 0)]
    anchors = sorted({i for i, _, _ in rows if i is not None and i % 10 == 0})
    assert mine(spark, rows) == plain_negatives(rows, anchors)


def test_negatives_of_empty_and_huge(spark):
    assert mine(spark, []) == []
    rows = [(i, [float(x) * 1e5, float(i)], i % 2) for i, x in enumerate(range(-10, 30))]
    assert mine(spark, rows) == plain_negatives(rows, [0, 10, 20, 30])


def test_rings_are_left_out(spark, monkeypatch):
    """Far groups aren't scanned: the bound certifies without them."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(16)[i % 4] * 3 + rng.normal(size=16) * 0.02).tolist(), i // 4 % 2) for i in range(2048)]
    d = spark.createDataFrame([(i, v, label, "", 0, 0) for i, v, label in rows], VECTORS)
    v = negatives.integer_vectors(d, "vec_id", "embedding", 256, "label")
    index = negatives.Index(v.select("vec_id", "label", "v", "norm2"))
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("anchor_id"), "label", "v", "norm2", F.array(F.lit(500_000).cast("long")).alias("low"), F.array(F.lit(2**62)).alias("high"), F.lit(-1).alias("done"))
    routed = q.mapInArrow(negatives._routed(index.pivots, index.rings, index.first, True, False), f"{negatives.ANCHOR}, done int, blocks array<long>").first()
    assert 0 < len(routed["blocks"]) < len(index.rings) / 2


def plain_trie(rows):
    """(rows of the trie) from (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    nodes = {tuple(t[:d]) for t in full.values() for d in range(len(t) + 1)}
    under = {n: sorted(c for c, t in full.items() if tuple(t[: len(n)]) == n) for n in nodes}
    kids = defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    out = []
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        saved = sum((len(under[m]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in under[n] if len(full[c]) == len(n))
        out.append((under[n][0], len(n), under[n[:-1]][0] if n else None, len(under[n]), kids[n], sum(kids[m] == 0 for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run_trie(spark, rows):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, n string, d0 int")
    return sorted(map(tuple, trie.prefix_trie(d).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in [*range(-25, 90), 400, 401, 777]:
        rows += [(c, t, ("user", "assistant")[t % 2], ("a b", "a", "", " c d\te ")[rng.integers(0, 4 if t > 1 else 2)]) for t in range(rng.integers(1, 7))]
    rows += [(5000, t, "user", f"turn {t % 7}") for t in range(300)]  # one conversation holds many rows
    rows += [(5001, t, "user", f"turn {t % 7}") for t in range(280)]
    rows += [(600 + i, 0, "user", "same") for i in range(60)]  # a hot first turn
    rows += [(900, None, "user", "first"), (900, 0, None, None), (900, 0, "user", "z"), (900, 0, "user", "a"), (900, 0, "user", "a"), (None, 0, "user", "nobody"), (920, 1, "système", "é" * 50_000)]
    assert run_trie(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert run_trie(spark, []) == [] and run_trie(spark, [(None, 1, "a", "b")]) == []
    assert run_trie(spark, [(61, 0, None, "w w")] * 2) == plain_trie([(61, 0, None, "w w")] * 2)


def test_lists_of_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = spark.createDataFrame([(1, 2, 3, i, True) for i in range(50)] + [(0, 0, 0, 7, True), (0, 0, 0, 8, False)], "depth long, d0 long, d1 long, conv_id long, ends boolean")
    got = {r.depth: r.ends_sha256 for r in trie.end_hashes(rows.repartition(5)).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest(), 0: hashlib.sha256(b"7").hexdigest()}


def test_running_sums_cross_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(k), int(x)) for k, (g, x) in enumerate(zip(np.sort(rng.choice([1, 2, 2, 2, 2, 3, 9], 2000)), rng.integers(-(2**63), 2**63 - 1, 2000), strict=True))]
    got = scan.running(spark.createDataFrame(rows, "g long, k long, x long").withColumn("y", F.lit(1).cast("long")).repartition(6), "g", [F.col("k")], {"x": 0x9E3779B97F4A7C15, "y": 1}, "test")
    by = {r.k: r for r in got.collect()}
    n, total = defaultdict(int), defaultdict(int)
    for g, k, x in rows:
        before = total[g]
        n[g] += 1
        total[g] = scan.signed((total[g] + x * pow(0x9E3779B97F4A7C15, n[g], scan.WORD)) % scan.WORD)
        assert (by[k].n, by[k].y, by[k].y_before, by[k].x, by[k].x_before) == (n[g], n[g], n[g] - 1, total[g], scan.signed(before % scan.WORD))


WORDS = "the of and to in that is was for on with as by at from are this be which or".split()


def labelled_texts(n):
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        w = rng.choice(WORDS, 60).tolist()
        good = i % 3 != 0
        text = " ".join(w).capitalize() + "." if good else (" ".join(x.upper() + "!!" for x in w) if i % 2 else " ".join([w[0]] * 60))
        out.append((i, text, int(good)))
    return out


def quality(spark, docs, labels, **more):
    d = spark.createDataFrame([(i, t, "en", 1) for i, t in docs], "doc_id long, text string, label string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    return neighbours.score_quality(d, lab, **more)


def test_held_out_accuracy_and_inputs(spark):
    rows = labelled_texts(400)
    docs = [(i, t) for i, t, _ in rows]
    labels = [(i, q, 0, "x") for i, _, q in rows]
    got = {r.doc_id: r for r in quality(spark, docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [got[i].predicted == q for i, _, q in rows if got[i].held_out]
    assert len(held) > 100 and np.mean(held) > 0.97
    # labels of held-out rows are never looked at
    flipped = [(i, 1 - q if got[i].held_out else q, 0, "x") for i, q, *_ in labels]
    assert {r.doc_id: r.score for r in quality(spark, docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_votes_equal_brute_force():
    rows = labelled_texts(120)
    terms = neighbours.weighted(np.stack([neighbours.term_counts(t) for _, t, _ in rows]))
    labels = np.array([q for *_, q in rows])
    v = neighbours.Voters(terms, labels, (1000, 3000), 16, 7)
    x = v.latent(terms)
    for i, s in enumerate(v.score(terms)):
        sims = sorted(((float(x[i] @ y), j) for j, y in enumerate(v.vectors)), reverse=True)
        sims = [(c, j) for c, j in sims if c <= neighbours.SAME][:7]
        votes = [(max(c, 0) ** neighbours.SHARPNESS * v.weights[j], labels[j]) for c, j in sims]
        assert s == pytest.approx(sum(w * q for w, q in votes) / sum(w for w, _ in votes), abs=1e-4)


def test_quality_edges(spark):
    rows = labelled_texts(60)
    odd = [(1000, None), (1001, ""), (1002, "a"), (1003, "the of " * 400_000), (None, "x y"), (1004, "\0😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    docs = [(i, t) for i, t, _ in rows] + odd + odd
    labels = [(i, q, 0, "x") for i, _, q in rows] * 2 + [(3, None, 0, ""), (6, 7, 0, ""), (None, 1, 0, ""), (99999, 1, 0, "")]
    got = quality(spark, docs, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    drawn = [q for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    (empty,) = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert empty == pytest.approx(np.mean(drawn + [1] * (zlib.crc32(b"99999") % 3 != 1)), abs=1e-6)
    assert {(r.score, r.predicted) for r in quality(spark, [(1, "a b c")], []).collect()} == {(0.5, 1)}
    assert quality(spark, [], labels).count() == 0
    one = {r.score for r in quality(spark, docs, labels, sample=5, k=3).collect()}
    assert one
