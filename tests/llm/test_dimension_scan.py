from __future__ import annotations

import numpy as np

from tallyweave.llm import dimension_scan as ds

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x)], SCHEMA)


def best(x, ids, query, k=20):
    x = x.astype(np.float32).astype(np.float64)
    score = x @ x[query]
    order = [i for i in np.lexsort((ids, -score.round(12))) if ids[i] != ids[query]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def recall(df, x, ids, settings):
    got = {}
    for r in ds.search(df, settings=settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [k for k in range(len(ids)) if ids[k] % 20 == 0]
    assert sorted(got) == sorted(int(ids[k]) for k in queries)
    hits = total = 0
    for k in queries:
        want, have = best(x, ids, k), got[ids[k]]
        assert [r for r, _, _ in have] == list(range(1, len(want) + 1))
        assert [(-s, v) for _, v, s in have] == sorted((-s, v) for _, v, s in have)
        true = dict(zip(ids, x.astype(np.float32).astype(np.float64) @ x[k].astype(np.float32).astype(np.float64)))
        assert all(abs(true[v] - s) < 1e-9 for _, v, s in have)
        hits += sum(s >= want[-1][1] - 1e-9 for _, _, s in have)
        total += len(want)
    return hits / total


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    ids = np.arange(1500) * 3
    settings = ds.Settings(sample=600, bound_rows=100, part=200, chunk=64, columns=6)
    assert recall(frame(spark, x, ids), x, ids, settings) >= 0.9


def test_one_vector_a_third_of_the_time(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8))
    x[::3] = x[0]
    ids = np.arange(900)
    settings = ds.Settings(sample=300, bound_rows=64, part=50, chunk=32, columns=4)
    assert recall(frame(spark, x, ids), x, ids, settings) >= 0.9
    got = ds.search(frame(spark, x, ids), settings=settings).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3 * k for k in range(1, 21)]


def test_a_test_abandons_early_but_not_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    s = ds.Settings(sample=400, bound_rows=200)
    index = ds.fit_index(np.arange(400), x, 400, float(np.linalg.norm(x, axis=1).max()), s)
    got = ds.scan(x[:3], np.arange(3), np.full(3, np.inf), x, np.arange(400), index, s)
    for q in range(3):
        mine = {v for a, v, _ in got if a == q}
        want = {v for v, _ in best(x, np.arange(400), q)}
        assert len(mine & want) >= 19


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0),
            (None, [1.0, 1.0], 0), (7, [1.0, 1.0, 1.0], 0), (8, [2.0, 1.0], 0), (8, [2.0, 1.0], 0), (9, [-1.0, 1.0], None), (20, [0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS list", "0.5 AS score")
    got = ds.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 8), (0, 2, 20), (0, 3, 9), (20, 1, 0), (20, 2, 8), (20, 3, 9)]
    assert ds.search(df.limit(0)).count() == 0
    assert ds.search(df.filter("vec_id = 0")).count() == 0
