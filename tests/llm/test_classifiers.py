from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import compression_classifier as cc, toxicity as tx
from tallyweave.llm.common import Sample, labelled_sample
from tallyweave.llm.queries import fold

SF = "/root/testdata/sf0.01"


def accuracy(spark, op, model, label, held):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = op.score(docs.join(labels.filter(held), "doc_id"), model).select("score", label).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    good, bad = ([r.score for r in rows if r[label] == y] for y in (1, 0))
    return np.mean([[x > y for y in bad] for x in good])


def test_compression_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = cc.fit(docs, labels, fold("doc_id", 4) != 2)
    assert accuracy(spark, cc, model, "quality", fold("doc_id", 4) == 2) > 0.9
    assert model == cc.fit(docs.repartition(7), labels.repartition(3), fold("doc_id", 4) != 2)


def test_compression_reads_the_whole_text():
    rng = random.Random(2)
    good = [" ".join(rng.choices(["river", "stone", "cloud", "meadow", "bridge", "winter"], k=90)) for _ in range(60)]
    bad = [" ".join(rng.choices(["$$$", "CLICK!!", "###buy", "%%%now", "free$$"], k=90)) for _ in range(60)]
    model = cc.train(Sample(tuple([(t, 1) for t in good] + [(t, 0) for t in bad]), (60, 60)))
    s = model.scorer()
    both = good[0] + " " + " ".join(bad)
    one, mixed, low = s.score([s.difference(good[1]), s.difference(both), s.difference(bad[1])])
    assert one > 0.9 and low < 0.1 and mixed < 0.2


def test_sample_is_bounded_and_keeps_to_the_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    twice = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")).filter("doc_id < 50"))
    got = labelled_sample(docs, twice, "quality", fold("doc_id", 4) != 2, 20, 100)
    assert len(got.rows) == 40 and max(len(t) for t, _ in got.rows) <= 100
    texts = {r.text for r in docs.filter((fold("doc_id", 4) == 2) | (F.col("doc_id") < 50)).collect()}
    assert not any(t in texts for t, _ in got.rows if len(t) < 100)


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for op, label in ((cc, "quality"), (tx, "toxic")):
        model = op.fit(odd, labels, F.lit(True), label=label)
        assert op.score(none, model).count() == 0
        out = op.score(odd.withColumn("score", F.lit("old")), model)
        rows = out.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
        empty = op.fit(none, labels.limit(0), F.lit(True), label=label)
        assert {r.score for r in op.score(odd, empty).collect()} == {0.5}


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    s = tx.Settings(window=5, hidden=3, attention=3, word_dim=2, char_dim=2, buckets=32)
    p, _ = tx._start(s, [{"abc", "de"}, {"xyz"}] * 3, np.array([0, 1] * 3))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, rows = rng.standard_normal((6, 4)), rng.integers(0, 6, (4, 5))
    filled = np.arange(5) < np.array([5, 3, 4, 1])[:, None]
    y, w = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 1.0])
    _, g, dx = tx.gradients(p, x, rows, filled, y, w)
    for name in ("w", "u", "c", "b", "wa", "ba", "va", "wo", "bo"):
        for _ in range(3):
            at, e = tuple(rng.integers(0, n) for n in p[name].shape), 1e-3
            loss = []
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += sign * e
                loss.append(tx.gradients(q, x, rows, filled, y, w)[0])
            assert abs((loss[0] - loss[1]) / (2 * e) - g[name][at]) < 1e-4 + 1e-2 * abs(g[name][at])
    total = np.zeros_like(x)
    np.add.at(total, rows.ravel(), dx.reshape(-1, 4))
    e, loss = 1e-3, []
    for sign in (1, -1):
        z = x.copy()
        z[2, 1] += sign * e
        loss.append(tx.gradients(p, z, rows, filled, y, w)[0])
    assert abs((loss[0] - loss[1]) / (2 * e) - total[2, 1]) < 1e-4


def test_windows_overlap_and_cover():
    s = tx.Settings()
    for n in (0, 1, 12, 13, 48, 49, 84, 85, 1000):
        starts = tx.windows(n, s)
        assert {k for a in starts for k in range(a, min(n, a + s.window))} == set(range(n))
        assert all(b - a == s.stride for a, b in zip(starts, starts[1:]))


def test_toxic_words_are_found_anywhere_in_long_texts():
    rng = random.Random(5)
    clean = ["".join(rng.choices("bcdfglmnprstaeiou", k=rng.randint(2, 8))) for _ in range(800)]
    rude = ["scumling", "scumlish", "trashopath", "trashopant", "morvid"]

    def text(n, toxic, words=rude):
        w = rng.choices(clean, k=n)
        for _ in range(2 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(words))
        return " ".join(w)

    sample = [(text(rng.randint(20, 200), y), y) for y in (0, 1) for _ in range(150)]
    model = tx.train(Sample(tuple(sample), (900, 150)))
    scorer = tx.Scorer(model)
    # Forms that training has not seen are known by their parts.
    bad = scorer.score([text(5000, 1, ["scumlisher", "trashopanty"]) for _ in range(10)])
    good = scorer.score([text(5000, 0) for _ in range(10)])
    assert (bad > 0.5).mean() > 0.8 and (good < 0.5).mean() > 0.8
    same = text(300, 1)
    assert scorer.score([same])[0] == tx.Scorer(model).score(["x", same])[1]


def test_toxic_parts_after_the_40th_character_of_a_token_count():
    assert tx.tokens_of("a bc") == [b"a", b"bc"] and tx.tokens_of(None) == [] and tx.tokens_of("-" * 90) == [b"-" * 90]
    rng = random.Random(8)
    signs = [chr(0x4E00 + k) for k in range(300)]
    for n in (41, 44, 45, 52, 53, 500):
        word = "".join(rng.choices(signs, k=n))
        pieces = [p.decode() for p in tx.tokens_of(f"x {word}")[1:]]
        assert max(map(len, pieces)) <= tx.PIECE
        assert {word[i : i + 5] for i in range(n - 4)} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
    clean = ["".join(rng.choices("bcdfglmnprstaeiou", k=rng.randint(2, 8))) for _ in range(800)]
    rude = ["scumling", "trashopath", "morvid"]
    sample = []
    for y in (0, 1):
        for _ in range(150):
            w = rng.choices(clean, k=rng.randint(20, 200))
            for _ in range(2 * y):
                w.insert(rng.randrange(len(w)), rng.choice(rude))
            sample.append((" ".join(w), y))
    scorer = tx.Scorer(tx.train(Sample(tuple(sample), (150, 150))))
    # Words chained by dashes are one token; they differ only after its first forty characters.
    start = ["-".join(rng.choices(clean, k=30)) for _ in range(30)]
    assert all(len(tx.normal(w.encode())) > 40 for w in start)
    bad, good = scorer.score([f"{w}-{'-'.join(rude)}" for w in start]), scorer.score([f"{w}-{'-'.join(rng.choices(clean, k=3))}" for w in start])
    assert (bad > good).mean() > 0.8
