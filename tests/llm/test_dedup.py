import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import components, simhash, suffix

R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdeé") for _ in range(R.randrange(1, 8))) for _ in range(300)]


def words(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    links = chain + star + [(500, 400), (400, 500), (7, 7)]
    out = components.components(spark.createDataFrame(links, "a long, b long").repartition(7))
    got = {r.node: r.root for r in out.collect()}
    want = {k: v for k, v in brute_components(links).items() if k != v}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_decoding():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 2000)
    near = simhash.codeword_index(w)
    code = (near << 11) | (simhash.golay_tables()[0][near] & 0x7FF)
    assert (np.bitwise_count(code ^ w) <= 3).all()


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(12):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64).view(np.int64)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).distinct().collect()
    want = {(int(min(a, b)), int(max(a, b))) for i, a in enumerate(fps) for b in fps[:i] if (int(a) ^ int(b)) & (2**64 - 1) and ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 3}
    assert {(r.a, r.b) for r in links} == want and len(want) > 100


def test_near_duplicates(spark):
    t = words(300)
    rows = [(5, t, "z"), (3, t, "z"), (9, words(200), "z"), (11, None, "z"), (10, "", "z"), (None, t, "z"), (12, "A b", "z"), (13, "a  B", "z"), (13, "a  B", "z")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 9
    assert got[5].component_id == got[3].component_id == got[None].component_id == 3
    assert got[9].component_id == 9 and got[11].component_id == 10
    assert got[12].component_id == 12 and got[13].component_id == 12
    assert got[10].fingerprint == "0" * 16
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d", "c d c", "d c d")]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > 4)
    assert simhash.fingerprint("A b\tc\n D c\x0bd") == want


def test_keep_one(spark):
    base = words(200).split(" ")
    edited = [*base[:100], "edit", *base[101:]]
    rows = [(4, " ".join(base), "en"), (2, " ".join(edited), "en"), (7, words(200), "en"), (8, None, "en"), (9, "", "en"), (7, words(5), "en"), (None, "x", "en")]
    rows += [(7, rows[2][1], "en"), (None, " ".join(base).upper().replace("É", "é"), "en"), (8, None, "en"), (30, "lone  Word", "a"), (30, "lone word", "b")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fps string"))
    assert kept.columns == ["doc_id", "text", "fps"]
    # two different texts share id 7, and rows without words are no duplicates, whatever their id
    assert sorted(((r.doc_id, len(r.text or "") > 60) for r in kept.collect()), key=str) == sorted([(2, True), (7, True), (7, False), (8, False), (8, False), (9, False), (None, False), (30, False)], key=str)
    clash = spark.createDataFrame([(1, "a b", 1, 2, 3), (2, "a b", 4, 5, 6)], "doc_id long, text string, n long, row long, `__gone` long")
    assert [tuple(r) for r in simhash.keep_one(clash).collect()] == [(1, "a b", 1, 2, 3)]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def nodes_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    return simhash.signatures(docs).withColumn("node", F.col("doc_id")).cache(), docs


def brute_links(texts, near=None):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if (near is None or near(i, j)) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def connected(links, pairs):
    at = brute_components(links)
    return [at.get(a, a) == at.get(b, b) for a, b in pairs]


def test_star_of_copies_equals_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(3000)]
    base = rng.sample(vocabulary, 150)

    def edited():
        out = list(base)
        for i in rng.sample(range(150), 3):
            out[i] = rng.choice(vocabulary)
        return " ".join(out)

    texts = [edited() for _ in range(400)]
    texts.insert(200, " ".join(base))
    nodes, docs = nodes_of(spark, texts)
    got = [tuple(r) for r in simhash.similar_links(nodes, docs, 5, 0.8).collect()]
    want = brute_links(texts)
    assert set(got) <= {(min(p), max(p)) for p in want} and len(want) > len(texts)
    assert all(connected(got, want))


def test_copies_without_a_common_original(spark):
    """Edits wander from text to text, so no leader is similar to all; links between its followers are found all the same."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(3000)]
    texts, now = [], rng.sample(vocabulary, 160)
    for _ in range(150):
        now = list(now)
        now[rng.randrange(160)] = rng.choice(vocabulary)
        texts.append(" ".join(now))
    nodes, docs = nodes_of(spark, texts)
    got = [tuple(r) for r in simhash.similar_links(nodes, docs, 5, 0.8).collect()]
    want = brute_links(texts)
    assert set(got) <= {(min(p), max(p)) for p in want}
    assert all(connected(got, want)) and len(set(brute_components(got).values())) == 1


def test_candidate_pairs_miss_nothing(spark):
    rng = random.Random(9)
    sets = [sorted(rng.sample(range(60), rng.randrange(8, 30))) for _ in range(200)]
    sets += [sorted({*s[1:], 100 + i}) for i, s in enumerate(sets)]
    frame = spark.createDataFrame([(i, i % 7, s) for i, s in enumerate(sets)], "node long, label long, shingles array<long>")
    got = {tuple(r) for r in simhash.candidate_pairs(frame, 0.8).collect()}
    want = {(j, i) for i in range(len(sets)) for j in range(i) if i % 7 != j % 7 and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert want and want <= got


def test_similar_texts_far_apart_by_fingerprints(spark):
    """Texts of five different words, and the same with a few new ones behind: shingles are similar, fingerprints of words aren't."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(6000)]
    texts = []
    for _ in range(60):
        t = rng.choices(rng.sample(vocabulary, 5), k=220)
        texts += [" ".join(t), " ".join([*t, *rng.sample(vocabulary, 40)])]
    nodes, docs = nodes_of(spark, texts)
    want = {(min(p), max(p)) for p in brute_links(texts)}
    assert {tuple(r) for r in simhash.similar_links(nodes, docs, 5, 0.8).collect()} == want and len(want) > 50


def test_open_nodes_lose_no_similar_pair(spark):
    """Of nodes without keys all similar pairs are found, by leading shingles alone, whatever their sizes."""
    rng = random.Random(22)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(4000)]
    texts = []
    for _ in range(120):
        t = rng.sample(vocabulary, rng.randrange(5, 200))
        texts += [" ".join(t), " ".join([*t, *rng.sample(vocabulary, rng.randrange(0, 1 + len(t) // 4))]), " ".join(rng.sample(vocabulary, 40) + t[:30])]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    nodes = spark.createDataFrame(
        [(i, i, h, [], simhash.leading(s := np.unique(simhash.shingle_hashes(t, 5)), 0.8).tolist(), *simhash.majority(s, simhash.LANES), 0, len(s)) for i, t, h in ((r.doc_id, r.text, r.h) for r in docs.collect())],
        "node long, doc_id long, h long, keys array<long>, first array<long>, " + ", ".join(f"{w} long" for w in simhash.FEATURES),
    )
    want = {(min(p), max(p)) for p in brute_links(texts)}
    assert {tuple(r) for r in simhash.similar_links(nodes, docs, 5, 0.8).collect()} == want and len(want) > 50


def test_unrelated_texts_share_no_key(spark, monkeypatch):
    """Rows that share a key follow from similar texts: texts of one vocabulary that have no shingle in common add none."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(5000)]
    texts = [" ".join(r.choices(vocabulary, k=80)) for _ in range(6000)]
    edited = texts[0].split()
    edited[40] = "edited"
    nodes, docs = nodes_of(spark, [*texts, " ".join(edited)])
    sizes, cut = {}, simhash.cut

    def counted(df, label):
        out = cut(df, label)
        sizes.setdefault(label, out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    assert [tuple(x) for x in simhash.similar_links(nodes, docs, 5, 0.8).collect()] == [(0, 6000)]
    assert 2 <= sizes["runs"] <= 2 * simhash.BANDS


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="the tables aren't there")
def test_recall_on_documents(spark):
    """Of all pairs of different texts that are similar, found by exact prefixes in plain Python, 0.9 or more are connected."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").groupBy("text").agg(F.min("doc_id").alias("doc_id")).withColumn("h", F.xxhash64("text")).cache()
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in docs.collect()}
    often = Counter(x for s in sets.values() for x in s)
    seen, want = {}, []
    for i in sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i])):
        s = sets[i]
        first = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1]
        want += [(i, j) for j in {j for x in first for j in seen.get(x, ())} if len(s & sets[j]) >= 0.8 * len(s | sets[j])]
        for x in first:
            seen.setdefault(x, []).append(i)
    nodes = simhash.signatures(docs).where("digest IS NOT NULL").withColumn("node", F.col("doc_id"))
    got = [tuple(r) for r in simhash.similar_links(nodes, docs, 5, 0.8).collect()]
    hit = connected(got, want)
    assert len(hit) > 40 and sum(hit) >= 0.9 * len(hit)


def test_recall_on_planted_copies(spark):
    """3,000 texts with a copy each, one word in fifty or fewer replaced: of those with similarity 0.8 to 0.95, 0.9 are connected."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeionrstlhdm") for _ in range(r.randrange(2, 9))) for _ in range(6000)]
    weights = [1 / (k + 3) for k in range(6000)]
    rows, want = [], []
    for i in range(3000):
        text = r.choices(vocabulary, weights, k=r.randrange(60, 400))
        copy = list(text)
        for k in r.sample(range(len(text)), max(1, round(len(text) / r.uniform(48, 150)))):
            copy[k] = r.choice(vocabulary)
        texts = [" ".join(text), " ".join(copy)]
        a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in texts)
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
        if 0.8 <= len(a & b) / len(a | b) <= 0.95:
            want.append((2 * i, 2 * i + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    nodes = simhash.signatures(docs).withColumn("node", F.col("doc_id"))
    got = [tuple(x) for x in simhash.similar_links(nodes, docs, 5, 0.8).collect()]
    hit = connected(got, want)
    assert len(hit) > 2000 and sum(hit) >= 0.9 * len(hit), (sum(hit), len(hit))
    assert all(a // 2 == b // 2 for a, b in got)


def brute_repeats(texts, n):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                edge[i] += 1
                edge[i + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repeat_texts():
    passages = [words(R.randrange(20, 120)) for _ in range(8)]
    texts = []
    for _ in range(90):
        parts = [(p := R.choice(passages))[R.randrange(len(p) // 2) : R.randrange(len(p) // 2, len(p) + 1)] if R.random() < 0.5 else words(R.randrange(1, 60)) for _ in range(R.randrange(1, 6))]
        t = " ".join(parts)
        if R.random() < 0.3 and texts and (t := R.choice(texts)):
            k = R.randrange(len(t))
            t = t[:k] + "X" + t[k + 1 :]
        texts.append(t)
    texts += ["", None, "a" * 199, "a" * 200, "b" * 201, "ab" * 300, "c" * 1500, words(50)]
    for k in (199, 200, 201, 202, 215):
        s = words(80)[:k]
        texts += [s + "@" + words(40), words(30) + "#" + s + "%" + words(5), s]
    return texts


def check_repeats(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(d).collect()}
    want = brute_repeats([t.encode() if t else b"" for t in texts], 200)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_equal_brute_force(spark):
    check_repeats(spark, repeat_texts())


def test_wide_runs_go_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix, "WIDE_RUN", 2)
    check_repeats(spark, repeat_texts()[:60])


def test_runs_span_ranges_and_batches():
    """Neighbours are found whatever the batches, and rows at a range's edges count as having one."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in rng.integers(0, 5, (300, 4)))
    cols = [np.array(x) for x in zip(*rows, strict=True)]
    cols += [np.arange(300), np.arange(300, dtype=np.int32), np.where(rng.random(300) < 0.1, suffix.MANY, suffix.ONE).astype(np.int8)]
    runs, firsts = Counter(r[:2] for r in rows), Counter(r[:3] for r in rows)
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], schema=suffix.SUFFIX) for i in range(0, 300, size)]
        out = [r for b in suffix._neighbours(iter(batches), 2, suffix.FIRST) for r in b.to_pylist()]
        kind = dict(enumerate(cols[6].tolist()))
        assert {r["row_key"] for r in out} == {i for i, r in enumerate(rows) if runs[r[:2]] > 1 or kind[i] == suffix.MANY or i in (0, 299)}
        assert {r["row_key"] for r in out if r["flags"] & suffix.FIRST} == {i for i, r in enumerate(rows) if firsts[r[:3]] > 1 or kind[i] == suffix.MANY}
        assert sum(r["flags"] & suffix.ASKED > 0 for r in out) == len({rows[r["row_key"]] for r in out})


def test_ranges_keep_the_order(spark):
    """Ranges follow the order of (head, lead, first) as signed longs, equal suffixes share one, and there are several."""
    rng = np.random.default_rng(6)
    cols = rng.integers(-3, 3, (3, 400)).astype(np.int64).view(np.uint64)
    splitters = np.array(sorted({tuple(x) for x in rng.integers(-3, 3, (9, 3)).tolist()}), np.int64).view(np.uint64)
    got = suffix.ranges_of(*cols, splitters)
    want = [sum(tuple(s) <= row for s in splitters.view(np.int64).tolist()) for row in zip(*cols.view(np.int64).tolist(), strict=True)]
    assert got.tolist() == want and len(set(want)) > 3
    docs = spark.createDataFrame([(i, words(120)) for i in range(60)], "carried long, text string").select("text", "carried")
    found = suffix.sampled_splitters(suffix._packed(docs), 200, 8).view(np.int64).tolist()
    assert len(found) == 7 and found == sorted(found)
    assert len(suffix.sampled_splitters(suffix._packed(docs.where("false")), 200, 8)) == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(8)
    words_ = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    group = rng.integers(0, 4, 500)
    seen = Counter((int(g), *w) for g, w in zip(group, words_.tolist(), strict=True))
    want = [seen[int(g), *w] > 1 for g, w in zip(group, words_.tolist(), strict=True)]
    assert suffix.equal_rows(group, lambda rows, k: words_[rows, k], 4).tolist() == want


def test_long_texts_and_equal_rows(spark):
    p = words(400)
    long = " ".join(words(300) + p for _ in range(60))
    texts = [long, "x" + p, p[:150], long[: len(long) // 2], "", None, p, p]
    check_repeats(spark, texts)
    rows = [(5, "same " + p, 1), (5, "same " + p, 1), (5, words(60), 2), (None, None, 3)]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lead long")).collect()
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in out) == [("5", False), ("5", True), ("5", True), ("None", False)]


def test_slabs_have_the_same_windows(monkeypatch):
    data = words(900).encode()
    whole = suffix.anchors(data, 200)
    monkeypatch.setattr(suffix, "SLAB", 700)
    parts = suffix.anchors(data, 200)
    places = lambda a: {(int(p), int(h)) for p, h in zip(a[0], a[2], strict=True)}
    assert places(whole) <= places(parts)


def test_drop_repeats(spark):
    p = words(60)
    rows = [(1, "ü" + p + "ü tail one", 3), (2, "other " + p, 3), (3, None, 3), (3, "", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    out = {(r.doc_id, r.row_key): r.text for r in suffix.drop_repeats(d).collect() if r.doc_id != 3}
    assert out[1, 3].endswith("tail one") and p[:150] not in out[1, 3] and len(out[2, 3]) < 50
    assert sorted(str(r.text) for r in suffix.drop_repeats(d).where("doc_id = 3").collect()) == ["", "None"]
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = d.select("doc_id", "text", F.lit(1).alias("a.b"), F.lit("x").alias("None"), F.struct(F.lit(1).alias("u.v")).alias("__null"))
    left = suffix.drop_repeats(odd)
    assert left.columns == odd.columns and {(r[0], r[2], r[3], r[4][0]) for r in left.collect()} == {(i, 1, "x", 1) for i in (1, 2, 3)}
