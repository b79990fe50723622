from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import negative_mining as nm
from tallyweave.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, s=nm.Mining(), every=100):
    """By all pairs; ``rows``: id, label and vector of whole numbers."""
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i % every:
            continue
        scored = sorted(
            (-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j, m, other == label) for m, (j, other, w) in enumerate(rows) if m != k
        )
        for p, pi, _, _ in [x for x in scored if x[3]][: s.positives]:
            fits = [x for x in scored if not x[3] and s.low * -p <= 100 * -x[0] <= s.high * -p][: s.negatives]
            out += [(i, pi, r + 1, j, -p, -q) for r, (q, j, _, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    return sorted(tuple(r[n] for n in NAMES) for r in nm.mine(df, settings=nm.Mining(**settings)).collect())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op11_coordinate_negatives']})").fetchall())
    got = sorted(tuple(r[n] for n in NAMES) for r in QUERIES["op11_coordinate_negatives"](spark, SF).collect())
    assert want and got == want


@pytest.mark.parametrize("settings", [{"shelf": 60, "bucket": 16, "sample": 10, "bands": 4}, {"shelf": 500, "bucket": 64, "sample": 1, "focus": 1}])
def test_lengths_ties_and_signs_against_all_pairs(spark, settings):
    """Vectors of very different lengths, many ties, zero and negative scores, clusters that pruning can tell apart."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-300, 300, size=(6, 8))
    rows = []
    for i in range(400):
        v = middle[i % 6] + rng.integers(-20, 20, size=8) if i % 3 else rng.integers(-2, 3, size=8)
        rows.append((i, int(rng.integers(0, 4)), (v * (1 + i % 5 * 40)).tolist()))
    rows[100] = (100, 1, [0] * 8)
    assert mined(spark, rows, **settings) == plain(rows, nm.Mining(**settings))


def test_pruning_leaves_few_candidates():
    """Where clusters are tight, the feasible ranges keep about an anchor's own cluster, and never lose a row."""
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((20, 16))
    middle *= 4000 / np.linalg.norm(middle, axis=1, keepdims=True)
    v = (np.repeat(middle, 50, axis=0) + rng.standard_normal((1000, 16)) * 10).astype(np.int64)
    s = nm.Mining(bucket=1000)
    shelf = nm.Shelf(np.arange(1000), np.arange(1000), np.zeros(1000, dtype=np.int64), v, s)
    a = v[7].astype(float)
    norm = np.linalg.norm(a)
    least = np.sort(v @ v[7])[-40]
    at = shelf.candidates(shelf.buckets[0], a / norm, np.argsort(-np.abs(a))[:4], least / norm)
    hit = np.flatnonzero(shelf.v @ v[7] >= least)
    assert at is not None and set(hit) <= set(at.tolist()) and len(at) < 300


def test_scores_beyond_doubles_are_exact(spark):
    big = 2**30
    rows = [(0, 1, [big, 1]), (1, 1, [big, 3]), (2, 1, [big, 2]), (3, 2, [big, 1]), (4, 2, [big, 0]), (5, 2, [big, 2])]
    assert mined(spark, rows) == plain(rows)


def test_edges(spark):
    none = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert nm.mine(none).count() == 0
    rows = [
        (None, 1, [1, 2]), (0, None, [1, 2]), (0, 1, None), (0, 1, [1, None]), (0, 1, []), (0, 1, [9, 9, 9]), (100, 1, [3, 4]), (100, 1, [3, 4]),
        (7, 1, [3, 3]), (8, 2, [3, 3]), (8, 2, [3, 3]), (9, 2, [0, 0]), (10, 3, [-1, -1]),
    ]
    valid = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and None not in r[2] and len(r[2]) == 2]
    assert mined(spark, rows) == plain(valid)
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("row", F.lit("x")).withColumn("shelf", F.lit(1)).withColumn("norm", F.lit("n"))
    assert sorted(tuple(r[n] for n in NAMES) for r in nm.mine(df).collect()) == plain(valid)
    # An anchor alone has no positives, a label alone no negatives.
    assert mined(spark, [(100, 1, [1, 1])]) == [] and mined(spark, [(100, 1, [1, 1]), (1, 1, [1, 1])]) == []


def test_components_are_rounded_down(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1.0],), ([float("nan"), 1.0, 1.0],), (None,), ([None, 1.0],)], "embedding array<float>")
    assert [r.vector for r in nm.whole(df).collect()] == [[128, -1, 256], None, None, None]
