import random

import numpy as np
import pyarrow as pa
import pytest

from sheetlens.llm import minhash as mh
from sheetlens.llm.text import words_of

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    ids = [i for i, _ in rows]
    sets = {i: shingle_set(t) for i, t in rows}
    texts = dict(rows)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b:
                x, y = sets[a], sets[b]
                same = words_of(texts[a]) == words_of(texts[b]) if x else (texts[a] and texts[a] == texts[b])
                if same or (x and y and len(x & y) / len(x | y) >= 0.8):
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    hot = " ".join(rng.choice(words) for _ in range(150))
    for k in range(40):  # a large group of near copies, and as many exact ones
        t = hot.split()
        t[rng.randrange(150)] = f"x{k}"
        rows += [(n, " ".join(t)), (n + 1, hot.upper() if k % 2 else hot + "!")]
        n += 2
    passage = " ".join(rng.choice(words) for _ in range(60))
    for k in range(40):  # a passage that many documents share
        rows.append((n, passage + " " + " ".join(rng.choice(words) for _ in range(60))))
        n += 1
    ids = list(range(n))
    rng.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed) + [(9000, None), (9001, ""), (9002, ""), (9003, "!!"), (9004, "!!"), (9005, "??"), (9006, "one two"), (9007, "One, two."), (9008, "z " * 60_000), (9009, "z " * 60_001)]
    df = spark.createDataFrame([*rows, (None, "one two")], SCHEMA).repartition(4).selectExpr("*", "1 AS id", "'x' AS kept")
    got = mh.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    classes = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert classes == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert all(r.class_size == sum(c == r.class_id for c in classes.values()) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("block,block_bytes", [(16, 16_000_000), (2048, 3_000)])
def test_small_blocks_find_the_same(spark, block, block_bytes):
    rows = corpus(4)
    got = mh.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block, block_bytes=block_bytes).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_group_whose_members_are_mostly_not_linked(spark):
    rng = random.Random(11)
    base, rows = [f"b{k}" for k in range(140)], []
    for n in range(150):  # two of them differ in about a quarter of their shingles
        t = list(base)
        for _ in range(rng.randint(2, 4)):
            t[rng.randrange(140)] = f"x{n}y{rng.randrange(9)}"
        rows.append((n, " ".join(t)))
    want = brute(rows)
    assert 1 < len(set(want.values()))
    got = mh.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=40)
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_rows_that_share_an_id_compare_all_their_texts(spark):
    rng = random.Random(12)
    t = [" ".join(f"s{k}w{rng.randrange(500)}" for _ in range(60)) for k in range(4)]
    near = lambda x: x + " more"
    rows = [(5, t[0]), (5, t[1]), (5, t[1].upper()), (9, near(t[0])), (7, near(t[1])), (8, t[2]), (8, t[2]), (3, t[3]), (8, None)]
    got = mh.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(r.doc_id, r.class_id, r.kept) for r in got} == {(5, 5, True), (9, 5, False), (7, 5, False), (8, 8, True), (3, 3, True)}
    assert sorted(r.class_size for r in got) == [1, 1, 2, 2, 5, 5, 5, 5, 5]


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(7)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = np.sort(h[:220]), np.sort(h[60:])
    wa, wb = rng.integers(1, 6, len(a)).astype(float), rng.integers(1, 6, len(b)).astype(float)
    exact = 0.0
    ia, ib = dict(zip(a, wa)), dict(zip(b, wb))
    for k in ia.keys() & ib.keys():
        exact += 1 / sum(max(ia.get(j, 0) / ia[k], ib.get(j, 0) / ib[k]) for j in ia.keys() | ib.keys())
    jac, prob = mh.similarity((a, wa), (b, wb))
    assert abs(prob - exact) < 1e-9 and abs(jac - 160 / 300) < 1e-9
    sig = mh.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    docs = [words_of(t) for _, t in corpus(3)[:20]] + [[]]
    hashes = mh.WordHashes()
    doc, h, c = mh.shingles(docs, hashes)
    whole = mh.signatures(doc, h, mh.weights(c), len(docs), 32)
    for i, d in enumerate(docs):
        doc, h, c = mh.shingles([d], hashes)
        assert (mh.signatures(doc, h, mh.weights(c), 1, 32)[0] == whole[i]).all()


def test_empty_table(spark):
    assert mh.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_of_a_group_and_of_two_blocks():
    # groups of rows: one block of four, two blocks of two and three, one row
    edge = np.array([0, 4, 9, 10])
    i = np.array([0] * 4 + [1] * 5 + [2])
    j = np.array([0] * 4 + [3] * 5 + [2])
    part = np.array([0] * 4 + [1, 1, 3, 3, 3] + [2])
    first, count = mh._partners(edge, i, j, part)
    got = {(u, v) for u in range(10) for v in range(first[u], first[u] + count[u])}
    assert got == {(u, v) for u in range(4) for v in range(u + 1, 4)} | {(u, v) for u in (4, 5) for v in (6, 7, 8)}
    assert [x for a, b in mh._runs(count, 3) for x in range(a, b)] == list(range(10))


def test_whole_groups_over_batches():
    key = [1, 1, 1, 1, 1, 2, 3, 3, 3, 3]
    for size in (1, 2, 3, 4, 10):
        batches = pa.table({"k": key, "row": list(range(10))}).to_batches(max_chunksize=size)
        groups = []
        for t, edge in mh._whole_groups(iter(batches), ["k"]):
            groups += [t["row"].to_pylist()[a:b] for a, b in zip(edge[:-1], edge[1:])]
        assert groups == [[0, 1, 2, 3, 4], [5], [6, 7, 8, 9]]
    assert list(mh._whole_groups(iter([]), ["k"])) == []


def test_sets_of_one_with_many():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (5, 30, 1, 60, 20)]
    counts = [None, rng.integers(1, 5, len(sets[1])).astype(np.int32), None, None, None]
    t = pa.table({"hashes": [x.tobytes() for x in sets], "counts": pa.array([None if c is None else c.tobytes() for c in counts], pa.binary())})
    one = mh._Sets(t)
    one.dense(1, 5)
    got = one.jaccard(1, np.array([2, 3, 4]))
    assert got.tolist() == [len(np.intersect1d(sets[1], sets[k])) / len(np.union1d(sets[1], sets[k])) for k in (2, 3, 4)]
    assert one.weighted(1, 3) == mh.similarity((sets[1], mh.weights(counts[1].astype(float))), (sets[3], np.ones(len(sets[3]))))[1]


def sketches(texts):
    """Registers of each text, and the byte of each, as bands of five."""
    doc, h, count = mh.shingles([words_of(t) for t in texts], mh.WordHashes())
    sig = mh.signatures(doc, h, mh.weights(count), len(texts), 160).reshape(-1, 32, 5)
    return sig, (mh._mix(sig) & np.uint64(255)).astype(np.uint8)


def test_bytes_equal_by_chance_lose_no_pair(spark):
    rng = random.Random(5)
    pairs = []
    for n in range(2500):
        a = [f"p{n}w{rng.randrange(1000)}" for _ in range(60)]
        b = a[:-5] + [f"p{n}x{k}" for k in range(5)]
        pairs.append((" ".join(a), " ".join(b)))
    sig, small = sketches([t for p in pairs for t in p])
    whole, seen = (np.all(x[::2] == x[1::2], axis=2) for x in (sig, small))
    odd = [n for n in range(len(pairs)) if whole[n].any() and seen[n].argmax() != whole[n].argmax()]
    assert odd  # the first band of equal bytes is none of equal registers
    rows = [(2 * n + k, pairs[n][k]) for n in odd for k in (0, 1)]
    got = mh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows) == {i: i - i % 2 for i, _ in rows}


def test_repeated_lines_lose_no_pair_of_equal_sets(spark):
    rng = random.Random(8)
    rows = []
    for n in range(20):  # a third of the words a hundred times over in one of the two
        w = [f"r{n}w{k}" for k in range(150)]
        rows += [(2 * n, " ".join(w + w[-50:])), (2 * n + 1, " ".join(w + w[-50:] * 100))]
    for n in range(20, 30):  # repeated in one, not in the other
        w = [f"r{n}w{k}" for k in range(150)]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(w + w[-50:] * 100))]
    rng.shuffle(rows)
    got = mh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows) == {i: i - i % 2 for i, _ in rows}


def test_sketch_cut_is_the_binomial_tail():
    cut = mh._least_equal(0.8, 160)
    below = lambda n: sum(mh.math.comb(160, k) * 0.8**k * 0.2 ** (160 - k) for k in range(n))
    assert below(cut) <= 3e-6 < below(cut + 1)
