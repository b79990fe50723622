"""Ordered arithmetic and matching against plain sequential code, hot keys included."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import match
from tallyweave.operators.ordered import exact_median, exclusive_prefix, previous_value
from tallyweave.session import cut


def _rows(n, seed):
    rnd = random.Random(seed)
    return [(("hot" if rnd.random() < 0.5 else rnd.choice("abc")), i, round(rnd.uniform(0, 5000), 2)) for i in range(n)]


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_prefix_is_the_same_for_hot_and_cold_keys(spark, hot_rows):
    data = _rows(400, 1)
    df = spark.createDataFrame(data, "k string, seq long, v double").repartition(5)
    got = {r.seq: (r.rows_before, float(r.v_before)) for r in exclusive_prefix(df, ["k"], [F.col("seq")], ["v"], hot_rows=hot_rows).collect()}
    seen: dict[str, list[float]] = {}
    for k, seq, v in data:
        before = seen.setdefault(k, [])
        assert got[seq][0] == len(before) and got[seq][1] == pytest.approx(sum(before))
        before.append(v)
    assert len(got) == len(data)


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_previous_value(spark, hot_rows):
    data = _rows(120, 2)
    df = spark.createDataFrame(data, "k string, seq long, v double").repartition(3)
    got = {r.seq: r.p for r in previous_value(df, ["k"], [F.col("seq")], "v", "p", hot_rows=hot_rows).collect()}
    last: dict[str, float] = {}
    for k, seq, v in data:
        assert got[seq] == last.get(k)
        last[k] = v


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 9 + [1e9], [-4.0, -2.5, 0.0, 7.25], [round(x * 1.37, 3) for x in range(1, 800)], [9999.99, 10000.0, 10000.01, 99999.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(4)
    assert exact_median(df, ["k"], "v").first()[1] == statistics.median(values)
    assert exact_median(df, ["k"], "v", which="upper").first()[1] == sorted(values)[len(values) // 2]


def _serve(reported, independent):
    """Serve reported rows in order: earliest free equal text, else earliest free related text."""
    free, out = dict(independent), {}
    for seq, text in reported:
        if not text:
            continue
        choice = next((i for i, t in free.items() if t == text), None)
        if choice is None:
            choice = next((i for i, t in free.items() if t and (text in t or t in text)), None)
        if choice is not None:
            out[seq] = choice
            del free[choice]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_partial_matching_equals_serving_in_order(spark, seed):
    rnd = random.Random(seed)
    words = ["", "a", "ab", "abc", "b", "bc", "xabcx", "zz", "zzz"] if seed % 2 else ["pay"] * 6 + ["pay 1", "pay 12", "ay", "x pay 1 y", "", "none"]
    r = [(i, rnd.choice(words)) for i in range(40)]
    i = [(j, rnd.choice(words)) for j in range(35)]
    a = spark.createDataFrame(r, "seq long, description string").repartition(3)
    b = spark.createDataFrame(i, "seq long, description string").repartition(3)
    got = {x.reported_seq: x.independent_seq for x in match.match(a, b, hot_rows=8 if seed > 3 else 10_000).collect()}
    assert got == _serve(r, i)


def test_exact_matching_and_report(spark):
    a = spark.createDataFrame([(0, "Ref 1"), (1, "ref 1"), (2, ""), (3, "x")], "seq long, description string")
    b = spark.createDataFrame([(0, "REF 1 "), (1, "y"), (2, "")], "seq long, description string")
    pairs = match.match(a, b, partial=False)
    assert [(p.reported_seq, p.independent_seq, p.match_type) for p in pairs.collect()] == [(0, 0, "exact")]
    status = [r["Status"] for r in match.report(a, b, pairs).collect()]
    assert sorted(status) == ["In independent only"] * 2 + ["In reported only"] * 3 + ["Matched"]


def test_contained_pairs_without_needles(spark):
    hays = spark.createDataFrame([(1, "abc")], "hay_id long, hay string")
    assert match.contained_pairs(spark.createDataFrame([("",)], "needle string"), hays).count() == 0


def test_median_of_one_bin_with_very_many_values(spark):
    # All values share four leading digits, so they fall into one bin, which is laid out.
    df = spark.range(4001).select(F.lit("k").alias("k"), (F.lit(1000.0) + F.col("id") / 100000.0).alias("v"))
    for which in ("mean", "upper"):
        assert exact_median(df, ["k"], "v", which=which, hot_rows=100).first()["median"] == 1000.0 + 2000 / 100000.0


def test_rounds_do_not_grow_with_rows_that_want_the_same_slots(spark, monkeypatch):
    counts = []
    for n in (3, 9):
        calls = []
        monkeypatch.setattr(match, "cut", lambda df, calls=calls: (calls.append(1), cut(df))[1])
        a = spark.createDataFrame([(k, f"fee {k:04d}") for k in range(n)], "seq long, description string")
        b = spark.createDataFrame([(k, "fee") for k in range(n)], "seq long, description string")
        got = {p.reported_seq: p.independent_seq for p in match.match(a, b).collect()}
        assert got == {k: k for k in range(n)}
        counts.append(len(calls))
    assert counts[0] == counts[1]
