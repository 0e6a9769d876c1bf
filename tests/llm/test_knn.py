import numpy as np
import pytest

from docparity.llm import knn

KIND = "vec_id long, embedding array<float>, distance double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1.0, 2) for i, v in rows], KIND)


def brute(rows, k):
    out = set()
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    for i in range(len(rows)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(int(ids[i]), r + 1, int(ids[j]), round(float(np.sqrt(d[j])), 5)) for r, j in enumerate(order)}
    return out


def got(df):
    return {(r["vec_id"], r["rank"], r["neighbor_id"], round(r["distance"], 5)) for r in df.collect()}


@pytest.mark.parametrize(("dim", "n", "grid"), [(2, 300, False), (16, 400, False), (3, 300, True), (1, 50, True)])
def test_against_brute_force(spark, dim, n, grid):
    rng = np.random.default_rng(dim)
    x = rng.integers(0, 4, (n, dim)) if grid else rng.normal(size=(n, dim))  # a grid is full of ties and repeats
    rows = list(zip(range(n), x.tolist()))
    assert got(knn.top_k(table(spark, rows), k=5, shard_vectors=60, leaf=8)) == brute(rows, 5)


def test_shards_of_a_cell_and_a_set_of_queries(spark):
    x = np.random.default_rng(7).normal(size=(300, 4))
    x[:100] = x[0]  # a third of all rows in one place
    rows = list(zip(range(300), x.tolist()))
    given = table(spark, rows)
    want = {r for r in brute(rows, 5) if r[0] % 50 == 0}
    assert got(knn.top_k(given, given.where("vec_id % 50 = 0"), k=5, shard_vectors=16, leaf=4, most_cells=4)) == want and len(want) == 30
    assert got(knn.top_k(given, given.where("vec_id < 0"), k=5)) == set()
    far = table(spark, [(-1, [50.0, 0, 0, 0]), (-2, [1.0])])
    nearest = np.lexsort((range(300), ((x.astype(np.float32).astype(float) - [50, 0, 0, 0]) ** 2).sum(axis=1)))[:5]
    assert [r["neighbor_id"] for r in knn.top_k(given, far, k=5).orderBy("rank").collect()] == nearest.tolist()


def test_odd_rows(spark):
    rows = [(1, [0, 0]), (2, [1, 0]), (2, [5, 5]), (3, [0, 1]), (4, [0, 0]), (None, [1, 1]), (5, None), (6, []), (7, [1]), (8, [None, 1]), (9, [float("nan"), 0]), (10, [float("inf"), 0]), (1, [0, 0])]
    assert got(knn.top_k(table(spark, rows), k=10)) == brute([(1, [0, 0]), (2, [1, 0]), (3, [0, 1]), (4, [0, 0])], 10)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])]])
def test_too_few(spark, rows):
    assert knn.top_k(table(spark, rows)).collect() == []


def test_all_the_same(spark):
    rows = [(i, [1.0, 1.0]) for i in range(40)]
    assert got(knn.top_k(table(spark, rows), k=3, shard_vectors=8, leaf=4)) == brute(rows, 3)
