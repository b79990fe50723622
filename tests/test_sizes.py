"""What large tables bring: wide keys, long shared beginnings, many rows of a file."""

from __future__ import annotations

import datetime
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyweave.catalog import entries
from tallyweave.operators import grids, match, positioned
from tallyweave.session import ensure_checkpoint_dir

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
_DAY = datetime.datetime(1996, 9, 13)


def _lineitem(spark, rows):
    """A folder whose ``lineitem`` has ``rows`` of order, part, line, price and flag."""
    folder = tempfile.mkdtemp(prefix="tallyweave-sizes-")
    full = [(o, p, 1, n, 1.0, price, 0.0, 0.0, flag, "O", _DAY) for o, p, n, price, flag in rows]
    spark.createDataFrame(
        full, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_table_balance_of_part_keys_above_a_million(spark):
    rows = [(1, 1_199_999, 2, 10.0, "N"), (1, 1_199_999, 1, 5.5, "N"), (1, 7, 1, 1.0, "R"), (2, 1_000_000, 1, 3.25, "R")]
    got = {r.account_ref: r.closing_balance for r in entries()["stmt_table_balance"].run(spark, _lineitem(spark, rows)).collect()}
    assert got == {"order-1": 14.5, "order-2": -3.25}


def test_search_gives_little_more_than_the_pairs(spark):
    rnd = random.Random(5)
    names = [f"collections:{rnd.randrange(10 ** rnd.randrange(1, 7))}" for _ in range(1500)]
    needles = sorted({n[rnd.randrange(len(n) - 1) :] for n in names[:700]} | set(names[:700]) | {"ü", "ns:1", "a" * 70, "𝄞x"})
    hays = [f"transfer for {n} thanks" for n in names] + ["", "ü", "çü", "b" + "a" * 71, "a" * 70, " 𝄞x𝄞"]
    want = sorted((n, k) for k, h in enumerate(hays) for n in needles if n in h and n != h)
    n = spark.createDataFrame([(x,) for x in [*needles, needles[0], "", None]], "needle string").repartition(3)
    h = spark.createDataFrame([*enumerate(hays), (len(hays), None)], "hay_id long, hay string").repartition(3)
    assert sorted((r.needle, r.hay_id) for r in match.contained_pairs(n, h).collect()) == want
    # Four common characters made a row each before: some 20 times the pairs.
    assert h.select(F.explode(match._finder(n, "needle")("hay"))).count() < 1.1 * len(want)


def test_bitmaps_that_are_full_miss_nothing_and_add_nothing(spark, monkeypatch):
    monkeypatch.setattr(match, "FILTER_BITS", 16)
    n = spark.range(60_000).select(F.concat(F.lit("no "), F.col("id")).alias("needle"))
    h = spark.range(500).select(F.col("id").alias("hay_id"), F.concat(F.lit("paid no "), F.col("id") * 100, F.lit(" today")).alias("hay"))
    got = {(r.needle, r.hay_id) for r in match.contained_pairs(n, h).collect()}
    assert got == {(f"no {str(k * 100)[:m]}", k) for k in range(500) for m in range(1, len(str(k * 100)) + 1)}


def test_rounds_leave_their_last_tables_only(spark):
    a = spark.createDataFrame([(k, f"fee {k % 7}") for k in range(40)], "seq long, description string")
    b = spark.createDataFrame([(k, f"fee {k % 5} {k}") for k in range(40)] + [(k, f"fee {k % 3}") for k in range(40, 60)], "seq long, description string")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert match.match(a, b).count() > 0
    # Two sides and the pairs; six tables for each round before.
    assert len(set(os.listdir(folder)) - before) <= 3


@pytest.mark.parametrize("name", ["src_table_stitch", "stmt_summaries"])
def test_statements_are_built_once(spark, name):
    # Their rows were computed anew wherever a step read them: up to twelve times.
    df = entries()[name].run(spark, SF)
    assert df.count() > 0 and not [f for f in df.inputFiles() if "lineitem" in f]


def test_stitching_carries_cells_of_headers_only(spark):
    rows = [("f", 1, 1, ["2024", "5"]), ("f", 1, 0, ["Date", " Amount "]), ("f", 0, 0, ["Balance"]), ("f", 2, 0, ["Date", "Amount"]), ("f", 2, 1, ["2025", ""]), ("g", 0, 0, ["x"]), ("g", 0, 1, ["Date"])]
    t = spark.createDataFrame(rows, "file string, table_no int, row_no int, cells array<string>")
    df = grids.stitch(t)
    assert sorted((r.table_no, [(p.column, p.value) for p in r.row]) for r in df.collect()) == [(1, [("Date", "2024"), ("Amount", "5")]), (2, [("Date", "2025"), ("Amount", "")])]
    # What is counted per table is told by numbers: no sort of whole rows.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^]]*table_no[^]]*\], \[[^\n]*cells", plan)


def test_words_are_written_nowhere(spark):
    rnd, words = random.Random(3), []
    heads = [("#", 10.0), ("DATE", 40.0), ("NARRATION", 120.0), ("DEBIT", 300.0), ("CREDIT", 400.0), ("BALANCE", 500.0)]
    lines = [heads, [("Page", 10.0), ("2", 40.0), ("of", 60.0), ("3", 80.0)], [("loose", 121.0), ("words", 150.0)], [("x", 12.0), ("rest", 122.0)],
             [("1", 12.0), ("May", 40.0), ("4", 58.0), ("2024", 72.0), ("pay", 121.0), ("-", 310.0), ("5.00", 410.0), ("9.00", 510.0)],
             [("2", 12.0), ("May", 40.0), ("5", 58.0), ("2024", 72.0), ("3.00", 310.0), ("6.00", 510.0)], [("3", 12.0), ("June", 40.0), ("without", 121.0), ("money", 150.0)]]
    for file in ("a", "b", "c", None):
        for page in range(1, 4):
            for k in range(14):
                for text, x0 in rnd.choice(lines):
                    words.append((file, page, text, x0, x0 + 20.0, 20.0 * k, 20.0 * k + 8.0))
    rnd.shuffle(words)
    df = spark.createDataFrame(words, "file string, page int, text string, x0 double, x1 double, top double, bottom double")
    for rows in (positioned.table_rows, positioned.raw_table):
        whole, spread = rows(df), rows(df, hot_rows=10)
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, spread.collect())) and whole.count() > 20
        # Lines and cells were both settled before, and shuffled four times.
        assert not [f for f in whole.inputFiles() if "settled-" in f]


def test_texts_that_share_an_id_meet_each_other(spark):
    h = spark.createDataFrame([("a", "at bank x"), ("a", "at bank x"), ("b", "bank x."), (None, "bank xy")], "hay_id string, hay string")
    n = spark.createDataFrame([("bank x",), ("bank x",)], "needle string")
    assert sorted(r.hay_id for r in match.contained_pairs(n, h).collect()) == ["a"] * 4 + ["b"]
