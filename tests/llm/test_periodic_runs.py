from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import periodic_runs as pr
from tallyweave.llm.queries import QUERIES
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w):
    """All runs, by trying every period at every place."""
    n, out, ids = len(w), [], {}
    w = np.array([ids.setdefault(x, len(ids)) for x in w])
    for q in range(1, n // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(int)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            x = w[i : j + q]
            if len(x) >= max(6, 4 * q) and not any((x[:-p] == x[p:]).all() for p in range(1, q)):
                out.append((i, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_against_plain():
    rng, texts = random.Random(3), []
    for _ in range(800):
        n, k = rng.randint(0, 110), rng.choice([1, 2, 3, 5])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.3:
                w[rng.randrange(n)] = b"x"
        texts.append(w)
    for w, runs in zip(texts, pr._batch(texts, pr.Limits()), strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain(w)


def test_query_against_plain(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert len(got) == len(rows) and any(r.n_runs for r in got.values())
    for i, text in rows:
        w, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs, drop = plain(w), set()
        for s, length, q in runs:
            drop.update(range(s + q, s + length))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in drop))


def test_edges(spark, odd, none):
    assert pr.periodic_runs(none).count() == 0 and pr.with_planted_repeats(none).count() == 0
    clash = odd.withColumn("periodic", F.lit(1)).withColumn("runs", F.lit(2)).withColumn("start", F.lit(3))
    out = pr.periodic_runs(pr.with_planted_repeats(clash))
    assert sorted(out.columns) == sorted(clash.columns)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.runs == 2 and r.start == 3 for r in rows)
    blank = [r.periodic for r in rows if not (r.text or "").strip()]
    assert len(blank) == 4 and all(b.n_words == 0 and not b.runs and b.collapsed == "" for b in blank)
    turns = spark.createDataFrame([(" ".join(f"w{i * 7919 % 5003}" for i in range(60_000)),)], "text string")
    long = pr.periodic_runs(turns).first().periodic
    # Its 5,003 words come in turn.
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 5003)] and len(long.collapsed.split()) == 5003


def test_equal_power_goes_to_the_first_run(spark):
    df = spark.createDataFrame([("x x x x x x a b c b c b c b c b c b c d d d d d d",)], "text string")
    p = pr.periodic_runs(df).select("periodic.*").withColumn("best", pr.greatest(F.col("runs"))).first()
    assert [tuple(r) for r in p.runs] == [(0, 6, 1), (7, 12, 2), (19, 6, 1)] and tuple(p.best) == (0, 6, 1)
    assert p.collapsed == "x a b c d"
