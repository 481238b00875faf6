import numpy as np
import pytest

from sheetlens.llm import embedjoin
from sheetlens.llm.graph import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, *_ in rows if i is not None}
    for a, (i, u) in enumerate(ok):
        for j, v in ok[a + 1 :]:
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for s in sorted(links):
        if s not in comp:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = s
                    todo += links[x]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def rows(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n // 8, n)] + rng.normal(size=(n, dim)) * 0.15
    x = np.where(rng.random(n)[:, None] < 0.5, near, base).astype(np.float32)
    x[: n // 4] = x[7] * rng.choice([1, 2, 0.5], n // 4)[:, None]  # a hot group of copies, some scaled
    ids = rng.permutation(n)
    return [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]


@pytest.mark.parametrize("seed,block,per_cell", [(1, 4096, 4096), (2, 16, 20), (3, 50, 7)])
def test_equals_brute_force(spark, seed, block, per_cell):
    data = rows(seed)
    data += [(9000, None, 1), (9001, [0.0] * 8, 1), (9002, [1.0, None] * 4, 1), (9003, [float("nan")] * 8, 1), (9004, [], 1), (9005, [float("inf")] * 8, 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, [1e-40] * 8, 1)]
    df = spark.createDataFrame([*data, (None, [1.0] * 8, 0)], SCHEMA).repartition(5).selectExpr("*", "'x' AS kept", "1 AS raw")
    got = embedjoin.near_duplicates(df, block=block, per_cell=per_cell).collect()
    assert len(got) == len(data) + 1
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute(data)
    assert [tuple(r)[1:] for r in got if r.vec_id is None] == [(0, None, True)]


def test_double_vectors_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e-200, 1e-205]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedjoin.near_duplicates(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    assert embedjoin.near_duplicates(df.filter("false")).count() == 0


def test_cells_lose_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, mask = embedjoin.cells_of(x, x[:25], np.sqrt(0.1))
    a, b = np.nonzero(x @ x.T >= 0.95)
    assert mask[a, home[b]].all() and mask.sum() < mask.size / 2


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 9), (20, 21), (21, 20), (None, 3), *((100 + i, 101 + i) for i in range(60)), *((500, 501 + i) for i in range(200))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys((3, 4, 5, 9), 3), 20: 20, 21: 20, **{100 + i: 100 for i in range(61)}, **{500 + i: 500 for i in range(201)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
