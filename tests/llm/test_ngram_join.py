from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import ngram_join as nj
from tallyweave.llm.components import components


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """Links and smallest reachable id of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), str(t), links[k], str(low.get(find(k)))) for k, (i, t) in enumerate(rows))


def check(df, join=nj.Join()):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = nj.link(df, join=join)
    from tallyweave.llm.common import text_key

    keyed = df.select(F.col("doc_id").alias("i"), F.col("text").alias("x")).withColumn("k", text_key(F.col("x"))).distinct()
    back = got.join(keyed, F.col("id").eqNullSafe(F.col("i")) & F.col("tk").eqNullSafe(F.col("k")))
    assert sorted((str(r.id), str(r.x), r.n_links, str(r.group_id)) for r in back.collect()) == plain(rows)


def near_group(spark, n=60, copies=25):
    """``n`` variants of one text, copies of another, and a chain whose ends are not linked."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(n):
        v = list(words)
        for _ in range(rng.randrange(3)):
            v[rng.randrange(len(v))] = f"x{k}"
        rows.append((1000 + k, " ".join(v)))
    rows += [(2000 + k, "one short text that is copied over and over") for k in range(copies)]
    chain = [f"c{i}" for i in range(130)]
    rows += [(3000 + k, " ".join(chain[k * 8 : k * 8 + 100])) for k in range(4)]
    rows += [(4000, "a b c"), (4001, "a b c"), (4002, "a b d")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_all_pairs(spark, documents, odd):
    check(documents)
    check(odd)
    check(near_group(spark))


def test_buckets_in_many_cells_count_each_pair_once(spark):
    check(near_group(spark), nj.Join(part=4))


def test_least_matches_is_the_posterior_tail():
    # With 64 of 96 matches 0.8 is still possible, with a third it is not.
    n = nj.least_matches(96, 0.8, 1e-6)
    assert 50 < n < 70 and nj.least_matches(16, 0.8, 1e-6) > 0
    rng = np.random.default_rng(0)
    assert (rng.binomial(96, 0.8, 100_000) < n).mean() < 1e-4


def test_keep_one(spark, odd, none):
    df = near_group(spark).withColumn("id", F.lit(1)).withColumn("tk", F.lit("x"))
    kept = nj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1000, 2000, 3000, 4000, 4002]
    left = nj.keep_one(odd)
    assert left.columns == odd.columns and left.filter("text is null").count() == 2
    assert left.filter("doc_id = 5").count() == 2 and left.count() == odd.count() - 1
    assert nj.keep_one(none).count() == 0 and nj.link(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
