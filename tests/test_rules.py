"""Anomaly rules, reconciliation and ranking on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.config import Thresholds
from tallyweave.operators import rank, reconcile, rules
from tallyweave.operators.rules.single import pattern_breaks

LIMITS = Thresholds()
_SCHEMA = "borrower string, key string, sheet string, value_date string, amount double, direction string, currency string, description string, account_ref string, confidence double, seq long"


def _frame(spark, rows):
    full = [
        (r.get("borrower", "b"), r.get("key", f"k{i}"), r.get("sheet", "bank"), r.get("date", "2024-01-01"), float(r["amount"]), "in", "", r.get("text", f"t{i}"), r.get("account", ""), 1.0, i)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, _SCHEMA)


def _hits(spark, name, rows):
    found = rules.detect(_frame(spark, rows), LIMITS, [name])
    return found.exceptions.orderBy("id").collect(), sorted(r.evidence_key for r in found.evidence.collect())


def test_duplicates_need_text_amount_and_date(spark):
    same = dict(amount=100, text="pay", date="2024-01-05")
    got, keys = _hits(spark, "dup", [same, same, {**same, "date": "2024-01-06"}, {**same, "amount": 101}])
    assert [(g.severity, g.evidence_count) for g in got] == [(0.5, 2)] and keys == ["k0", "k1"]


def test_round_amounts_must_be_material(spark):
    small = [dict(amount=10 + i) for i in range(9)]
    got, _ = _hits(spark, "round", [*small, dict(amount=5000), dict(amount=5001), dict(amount=300)])
    assert [g.first_evidence for g in got] == ["k11", "k9"] and got[1].severity == pytest.approx(0.8)
    assert _hits(spark, "round", [dict(amount=2000)] * 5)[0] == []


def test_volume(spark):
    got, _ = _hits(spark, "vol", [dict(amount=10)] * 5 + [dict(amount=101), dict(amount=100)])
    assert [g.first_evidence for g in got] == ["k5"]


def test_round_trip_takes_last_disbursement_and_first_collection(spark):
    rows = [dict(amount=1, text="disbursement:7", date="2024-01-01"), dict(amount=1, text="disbursement:7", date="2024-01-02"),
            dict(amount=1, text="collections:7", date="2024-01-02"), dict(amount=1, text="collections:7", date="2024-01-09"),
            dict(amount=1, text="disbursement:8", date="2024-01-01"), dict(amount=1, text="collections:8", date="2024-02-01")]
    got, keys = _hits(spark, "roundtrip", rows)
    assert [g.id for g in got] == ["b:anom:roundtrip:7"] and keys == ["k1", "k2"]


def test_pattern_break_needs_history(spark):
    jump = [dict(amount=a, account="x", date=f"2024-0{i + 1}-01") for i, a in enumerate([1000, 2000, 4000, 1_000_000])]
    assert [g.first_evidence for g in _hits(spark, "seqjump", jump)[0]] == ["k3"]
    assert _hits(spark, "seqjump", jump[2:])[0] == []
    assert _hits(spark, "seqjump", [{**j, "account": ""} for j in jump])[0] == []


def test_pattern_break_orders_by_time_not_text(spark):
    days = ["30-01-2024", "01-02-2024", "02-03-2024", "03-04-2024"]
    rows = [dict(amount=a, account="x", date=d) for a, d in zip([5, 5, 5, 900], days)]
    assert [g.first_evidence for g in _hits(spark, "seqjump", rows)[0]] == ["k3"]


def test_pattern_break_same_when_the_account_is_hot(spark):
    rnd = random.Random(5)
    rows = [dict(amount=rnd.choice([5, 8, 12, 900]), account=rnd.choice("xxxy"), date=f"2024-01-{1 + i % 28:02d}") for i in range(300)]
    p = rules.prepare(_frame(spark, rows))
    plain = {r.id for r in pattern_breaks(p, LIMITS).exceptions.collect()}
    hot = {r.id for r in pattern_breaks(p, LIMITS, hot_rows=20).exceptions.collect()}
    assert plain == hot and plain


def test_off_hours_needs_a_time(spark):
    rows = [dict(amount=1, date=d) for d in ("2024-01-01T23:45:00", "2024-01-01", "2024-01-01 14:30", "2024-01-01 04:59", "2024-01-01 05:00")]
    assert [g.first_evidence for g in _hits(spark, "offhours", rows)[0]] == ["k0", "k3"]
    assert _hits(spark, "offhours", [dict(amount=1, date="2024-01-01 00:00:00")] * 3)[0] == []


def test_structuring(spark):
    small = [dict(amount=50, account="y", date=f"2024-03-0{i + 1}") for i in range(6)]
    split = [dict(amount=a, account="x", date="2024-01-02") for a in (9800, 9700, 9900)]
    got, keys = _hits(spark, "microsplit", [*split, *small])
    assert keys == ["k0", "k1", "k2"] and got[0].severity == 0.85 and "~9,800.00" in got[0].description
    assert _hits(spark, "microsplit", [*split[:2], dict(amount=5000, account="x", date="2024-01-02"), *small])[0] == []
    assert _hits(spark, "microsplit", [*split[:2], *small])[0] == []


def test_structuring_equals_gathering_the_group(spark):
    rnd = random.Random(9)
    rows = [dict(amount=rnd.choice([100, 100, 112, 115, 116, 130, 86, 85, 84]), account=f"a{rnd.randint(0, 25)}", date=f"2024-01-0{rnd.randint(1, 3)}") for _ in range(260)]
    rows += [dict(amount=1) for _ in range(400)]
    groups: dict = {}
    for r in rows:
        if "account" in r:
            groups.setdefault((r["account"], r["date"]), []).append(float(r["amount"]))
    want = set()
    for (a, d), xs in groups.items():
        mid = sorted(xs)[len(xs) // 2]
        if len(xs) >= 3 and all(abs(x - mid) <= mid * 0.15 for x in xs) and sum(xs) > 3:
            want.add(f"b:anom:microsplit:{a}|{d}")
    assert {g.id for g in _hits(spark, "microsplit", rows)[0]} == want and want


def test_results_do_not_depend_on_partitions_or_order(spark):
    rnd = random.Random(3)
    rows = _frame(spark, [dict(amount=rnd.choice([10, 10, 1000, 3000]), text=rnd.choice("pq"), account=rnd.choice("xy"), date=f"2024-01-0{rnd.randint(1, 4)}") for _ in range(150)])
    a = rules.detect(rows.coalesce(1), LIMITS).exceptions.select("id", "severity", "description").collect()
    b = rules.detect(rows.orderBy(F.rand(7)).repartition(7), LIMITS).exceptions.select("id", "severity", "description").collect()
    assert sorted(a) == sorted(b)


def test_a_rule_can_be_registered(spark):
    def big(p, limits):
        return rules.REGISTRY["vol"](p, Thresholds(transaction_volume_multiple=1.0))

    rules.register("big", big)
    try:
        assert len(_hits(spark, "big", [dict(amount=1), dict(amount=1), dict(amount=3)])[0]) == 1
    finally:
        del rules.REGISTRY["big"]


def _pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "borrower string, rep_collections double, calc_collections double, rep_disbursements double, calc_disbursements double, rep_cash_total double, calc_cash_total double")


def test_thresholds_and_fee(spark):
    rows = _pairs(spark, ("fee", 100.0, 96.0, 50.0, 50.0, 0.0, 0.0), ("over", 100.0, 110.0, 1000.0, 1101.0, 100.0, 98.0), ("zero", 10.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    got = {(r.borrower, r.rule): r.severity for r in reconcile.reconcile(rows, LIMITS).collect()}
    assert set(got) == {("over", "recon:collections"), ("over", "recon:disbursements"), ("over", "recon:cash"), ("zero", "recon:collections")}
    assert got[("zero", "recon:collections")] == 1.0


def test_rank_spreads_and_keeps_the_raw_severity(spark):
    rows = [("a", f"a:anom:{r}:1", "anomaly", r, s, "d") for r, s in (("dup", 0.5), ("seqjump", 0.75), ("microsplit", 0.85))] + [("lone", "lone:anom:vol:1", "anomaly", "vol", 0.6, "d")]
    ex = spark.createDataFrame(rows, "borrower string, id string, kind string, rule string, severity double, description string")
    got = {r.id: r for r in rank.rank(ex).collect()}
    assert [got[f"a:anom:{r}:1"].severity for r in ("dup", "seqjump", "microsplit")] == [0.0, 0.7143, 1.0]
    assert got["lone:anom:vol:1"].severity == 0.0 and got["lone:anom:vol:1"].severity_raw == 0.6
    assert got["a:anom:seqjump:1"].description == "d [severity=0.71]"
    assert {r.rule for r in rank.referrals(rank.rank(ex)).collect()} == {"seqjump", "microsplit"}
