import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import neighbours, queries

KIND = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    out = {}
    for q, v in rows:
        if asked(q):
            near = sorted((-sum(float(a) * float(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    got = found(queries.op4_neighbours(spark, sf))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        mine = got[int(ids[q])]
        assert len(mine) == 20 and [a for a, _ in mine] == [a for a, _ in sorted(mine, key=lambda m: (-m[1], m[0]))]
        assert all(math.isclose(sc, float(x[list(ids).index(i)] @ x[q]), abs_tol=1e-12) for i, sc in mine[:3])
        hits, total = hits + len(best & {i for i, _ in mine}), total + 20
    assert hits / total >= 0.93


def test_split_lists(spark, monkeypatch):
    """Lists cut into many blocks, some of which hold no query or no candidate."""
    monkeypatch.setattr(neighbours, "LIST_BLOCK", 8)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((240, 5)).astype(np.float32)
    v[:120] = v[:120] * 0.01 + v[0]  # a third and more in one place
    rows = [(i, v[i].tolist()) for i in range(240)]
    got = found(neighbours.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 6 == 0, k=5, recall=1.0))
    want = brute(rows, lambda q: q % 6 == 0, 5)
    assert {q: len(x) for q, x in got.items()} == {q: 5 for q in want}
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_all_lists_probed_is_exact_with_ties_and_norms(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((300, 6)), 1).astype(np.float32) * rng.integers(1, 5, (300, 1)).astype(np.float32)
    v[50:120] = v[7]  # copies
    rows = [(i, v[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, KIND).withColumns({"h": F.lit("x"), "id": F.lit("y"), "v": F.lit(1)})
    got = found(neighbours.search(df, F.col("vec_id") % 10 == 0, k=5, recall=1.0))
    want = brute(rows, lambda q: q % 10 == 0, 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    # copies of a vector: the smallest ids, whatever the number of copies
    assert [i for i, _ in got[50]] == [i for i, _ in want[50]]


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, [0.5, 1.0]), (None, [1.0, 1.0]), (20, [0.1, 0.1]), (20, [0.1, 0.1]), (8, [1.0]), (40, [])]
    got = found(neighbours.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [6, 20], 20: [6, 0]}


def test_empty_one_and_few(spark):
    for rows in ([], [(0, None)]):
        assert neighbours.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0, 2.0])], KIND), F.lit(True)).count() == 0


@pytest.mark.parametrize("k", [3, 21])
def test_scan_against_all(k):
    rng = np.random.default_rng(1)
    c, q = rng.standard_normal((2500, 40)), rng.standard_normal((7, 40))
    model = neighbours.fit(c, float(np.linalg.norm(c, axis=1).max()), len(c))
    got = neighbours.scan_list(model, [[i] for i in range(len(c))], c, q, np.full(7, -np.inf), k)
    want = {(i, int(j)) for i in range(7) for j in np.argsort(-(c @ q[i]))[:k]}
    assert len(got) == 7 * k and len({(i, j) for i, _, j in got} & want) >= 0.97 * len(want)


def test_small_outlying_clusters_get_k_rows_too(spark):
    rng = np.random.default_rng(3)

    def directions(n):
        z = rng.standard_normal((n, 8))
        return z / np.linalg.norm(z, axis=1)[:, None]

    dense = np.repeat(directions(40), 50, axis=0) + rng.standard_normal((2000, 8)) * 0.02
    far = np.repeat(directions(60), 2, axis=0) + rng.standard_normal((120, 8)) * 0.001
    x = np.concatenate([dense, far]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    got = found(neighbours.search(df, F.lit(True), recall=0.9))
    assert len(got) == len(x) and {len(r) for r in got.values()} == {20}
    # k above the number of candidates: every one of them
    few = df.where("vec_id < 15 or vec_id >= 2115")
    assert {len(r) for r in found(neighbours.search(few, F.lit(True), k=50, recall=0.5)).values()} == {19}


def test_lists_probed_until_they_hold_enough():
    model = neighbours.Model(1.0, np.eye(2), np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [9.0, 0.0]]), 1)
    near = lambda need: [r.tolist() for r in model.lists_of(np.array([[0.1, 0.0], [8.0, 0.0]]), np.array([3, 0, 5, 40]), need)]
    assert near(3) == [[0], [3]] and near(8) == [[0, 1, 2], [3]] and near(40) == [[0, 1, 2, 3], [3]]
    assert near(99) == [[0, 1, 2, 3], [3, 2, 1, 0]]
