"""Files, mapping, statement text, positioned tables, cash maps, registry documents, stores."""

from __future__ import annotations

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyweave.config import FxPolicy, TapeColumns, Thresholds, category_rules
from tallyweave.functions import dates, money, text
from tallyweave.operators import aggregate, cashmap, fx, grids, normalize, positioned, registry_json, statements
from tallyweave.sources import store, tables


def _write(**files):
    folder = tempfile.mkdtemp(prefix="tallyweave-files-")
    for name, content in files.items():
        with open(os.path.join(folder, name.replace("__", ".")), "w", encoding="utf-8") as fh:
            fh.write(content)
    return folder


def _value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(column).first()[0]


@pytest.mark.parametrize("cell,want", [("$1,234.56", 1234.56), ("(200.00)", -200.0), ("-5", -5.0), ("KES -500", -500.0), ("", None), (".", None), ("n/a", None), ("1.2.3", None), ("2024", 2024.0)])
def test_parse_amount(spark, cell, want):
    assert _value(spark, money.parse_amount(F.col("c")), c=cell) == want


@pytest.mark.parametrize("cell,want", [("6,959,813.28", 6959813.28), (" 12 ", 12.0), ("", 0.0), ("nan", 0.0), ("1.0d", 0.0), ("1e3", 1000.0), ("Infinity", 0.0), (None, 0.0)])
def test_parse_money(spark, cell, want):
    assert _value(spark, money.parse_money(F.col("c")), c=cell) == want


def test_text_and_date_functions(spark):
    assert _value(spark, text.normalize_value(F.col("c"), ignore_spaces=True, ignore_special_chars=True), c=" Añ_b - c! ") == "añ_b-c"
    assert _value(spark, text.clean_plate(F.col("c")), c=" abc-123.é") == "ABC123É"
    assert _value(spark, dates.month_name_date(F.col("c")), c="June 23rd 2022") == "2022-06-23"
    assert _value(spark, dates.month_name_date(F.col("c")), c="Foo 4, 2026") == ""
    assert _value(spark, dates.month_key(F.col("c")), c="05-06-2026") == "2026-06"
    assert str(_value(spark, dates.parse_when(F.col("c")), c="01-06-2026")) == "2026-06-01 00:00:00"
    assert _value(spark, dates.parse_when(F.col("c")), c="June") is None
    assert _value(spark, text.containment_verdict(F.col("e"), F.col("b"), F.col("m")), e="Renault Logan 2019", b="Renault", m="Logan") == "Match"
    assert _value(spark, text.containment_verdict(F.col("e"), F.col("b"), F.col("m")), e="x", b="--", m="..") == "Match"
    assert _value(spark, text.exception_pattern(F.col("i"), F.lit("k")), i="r:asset:owner_mismatch:P") == "owner_mismatch"


def _tape(spark, **over):
    row = {"borrower": "b", "seq": 1, "loan_id": "L1", "begin_date": "2024-01-01", "principal_amount": "1,000", "total_loan_amount": "1090", "principal_outstanding": "0",
           "interest_outstanding": None, "fee_outstanding": "", "penalty_outstanding": "0", "closure_date": "", "company_due_date": "2024-06-01", "currency": "KES"} | over
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'long' if k == 'seq' else 'string'}" for k in row))


def test_tape_events(spark):
    ev = {e.direction: e for e in normalize.tape_events(_tape(spark)).collect()}
    assert (ev["out"].amount, ev["out"].value_date, ev["in"].amount, ev["in"].value_date) == (1000.0, "2024-01-01", 1090.0, "2024-06-01")
    assert [e.direction for e in normalize.tape_events(_tape(spark, principal_outstanding="1090")).collect()] == ["out"]
    floor = normalize.tape_events(_tape(spark, total_loan_amount="1000", principal_outstanding="-500"))
    assert {e.direction: e.amount for e in floor.collect()}["in"] == 1000.0
    signed = normalize.tape_events(_tape(spark, total_loan_amount="-1000", principal_outstanding="-600"), TapeColumns(negative_sign_borrowers=frozenset({"b"})))
    assert {e.direction: e.amount for e in signed.collect()}["in"] == 400.0
    assert normalize.tape_events(_tape(spark, begin_date="", company_due_date=None)).count() == 0


def test_column_map_never_guesses(spark):
    own = _tape(spark).withColumnRenamed("loan_id", "loanid").drop("total_loan_amount")
    config = TapeColumns(overrides={"b": {"loan_id": "loanid"}})
    ev = normalize.tape_events(normalize.resolve_tape(own, config.resolve("b"))).collect()
    assert [(e.key, e.amount) for e in ev] == [("tape:b:L1:disb", 1000.0)]


def test_roles():
    assert normalize.detect_roles(["Date", "Transaction Code", "Description", "Category", "Debit (-)", "Credit (+)", "Running Balance"]) == {
        "date": "Date", "description": "Description", "amount": None, "debit": "Debit (-)", "credit": "Credit (+)", "balance": "Running Balance"}
    assert normalize.detect_roles(["Value Date"])["amount"] == "Value Date" and not normalize.usable_roles(normalize.detect_roles(["DR", "CR", "date"]))
    assert normalize.is_tape(["loan_id", "begin_date", "principal_amount", "total_loan_amount", "principal_outstanding", "x"])


def test_statement_files_of_different_layouts(spark):
    folder = _write(
        split__csv="Date,Description,Debit (-),Credit (+),Running Balance\n2024-01-01,Pay,,\"1,500.25\",1500.25\n2024-01-02,\"Fee, bank\",10,,1490.25\n,none,5,,\n2024-01-03,zero,0,0,1490.25\n",
        signed__csv="date,amount,narration,currency\n2024-01-01,-20.5,out,KES\n2024-01-02,nan,skip,\n2024-01-03,7,in,\n",
        simple__csv="date,total,type\n2024-01-01,5,x\n",
    )
    rows = tables.load_statements(spark, folder).orderBy("account_ref", "seq").collect()
    assert [(r.account_ref, r.key, r.amount, r.direction, r.description) for r in rows] == [
        ("signed", "bank:signed:0", 20.5, "out", "out"), ("signed", "bank:signed:2", 7.0, "in", "in"),
        ("split", "bank:split:0", 1500.25, "in", "Pay"), ("split", "bank:split:1", 10.0, "out", "Fee, bank")]
    bal = normalize.closing_balance(tables.load_statements(spark, folder)).collect()
    assert {b.account_ref: b.closing_balance for b in bal} == {"split": 1490.25}


def test_wide_rows_quotes_and_equal_names(spark):
    wide = ",".join(["date", "amount", "description", *[f"x{i}" for i in range(140)], "balance"])
    row = ",".join(["2024-01-01", "5", '"He said ""hi"", twice\nand left"', *["0"] * 140, "77"])
    one, two = _write(statement__csv=f"{wide}\n{row}\n"), _write(statement__csv="date,amount\n2024-02-01,1\n2024-02-02,2\n")
    rows = tables.load_statements(spark, [one, two]).orderBy("value_date").collect()
    assert [(r.account_ref, r.amount, r.balance) for r in rows] == [("statement", 5.0, "77"), ("statement", 1.0, None), ("statement", 2.0, None)]
    assert rows[0].description == 'He said "hi", twice\nand left' and len({r.key for r in rows}) == 3
    texts = tables.read_statement_text(spark, [one, two])
    assert texts.select("file").distinct().count() == 2
    a, b = _write(r__csv="Placa,Status\nA1,Found\n"), _write(r__csv="Placa,Status\nA1,No data\n")
    for order, last in (((a, b), "No data"), ((b, a), "Found")):
        assert tables.load_registry_results(spark, [f"{p}/r.csv" for p in order]).first().status == last


def test_header_below_title_rows(spark):
    folder = _write(grid__csv="Statement of account\nOwner,Someone\nDate,Amount\n2024-01-01,3\n")
    got = tables.load_statements(spark, folder, detect_header=True).collect()
    assert [(r.key, r.amount) for r in got] == [("bank:grid:0", 3.0)]


def test_ledger_mapping_is_honoured(spark):
    df = spark.createDataFrame([("2024-01-31", "1,200.50", "Main", "KES", "led", 0), (None, "5", "x", "", "led", 1)], "as_of string, ledger_balance string, account string, currency string, account_ref string, seq long")
    got = normalize.simple_rows(df, sheet="ledger").collect()
    assert [(r.key, r.amount, r.direction, r.description, r.currency) for r in got] == [("ledger:led:0", 1200.5, "in", "Main", "KES")]


def test_register_and_results(spark):
    folder = _write(reg__csv="Plate Number,Borrower,Expected Owner\nA1,B, Ann \n,skip,x\n")
    assert [(r.plate, r.borrower, r.expected_owner) for r in tables.load_register(spark, folder).collect()] == [("A1", "B", "Ann")]
    old, new = _write(one__csv="Placa,Status,Propietario\nA1,Found,Ann\nA1,Found,Bob\n"), _write(two__csv="X,Status,Owner\nA1,No data,\n")
    got = tables.load_registry_results(spark, [f"{old}/one.csv", f"{new}/two.csv"]).collect()
    assert [(r.plate, r.status, r.owner) for r in got] == [("A1", "No data", "")]


def _parse(spark, body):
    return statements.parse(spark.createDataFrame([("f", body)], "file string, text string")).orderBy("line_no").collect()


def test_two_date_layout(spark):
    got = _parse(spark, "Period 01-06-2026\n01-06 01-06 REF0001 SOME PAYER 1177 1,500.25 9.15 25,476.83\n03-06 03-06 MOVE 03.06.26 NET 1181 -5,430.00 271.50 252.86\n04-06 04-06 ONLY 252.86")
    assert [(r.value_date, r.amount, r.direction, r.description, r.balance) for r in got] == [
        ("01-06-2026", 1500.25, "in", "REF0001 SOME PAYER 1177", 25476.83), ("03-06-2026", 5430.0, "out", "MOVE 03.06.26 NET 1181", 252.86)]


def test_single_date_layout(spark):
    got = _parse(spark, "12/03/2024 SALARY PAYMENT 1,500.00\nnothing here")
    assert [(r.value_date, r.amount, r.description, r.balance) for r in got] == [("12/03/2024", 1500.0, "SALARY PAYMENT", None)]


def test_iso_layout_and_first_row(spark):
    head = "STARTING BALANCE TOTAL DEPOSITS (+) TOTAL WITHDRAWALS (-) ENDING BALANCE\n$5,400.00 $3,000.00 $400.00 $8,000.00\n"
    lines = "2026-06-02 TXN-AAAA1 Payroll $3,000.00 $8,400.00\n2026-06-03 Rent $400.00 $8,000.00"
    assert [(r.direction, r.description) for r in _parse(spark, head + lines)] == [("in", "Payroll"), ("out", "Rent")]
    assert [r.direction for r in _parse(spark, "2026-06-02 Salary $10.00 $10.00\n2026-06-03 Shop $4.00 $6.00")] == ["in", "out"]
    df = spark.createDataFrame([("f", head + lines)], "file string, text string")
    tied = statements.tie_out(statements.parse(df), statements.shape(df)).first()
    assert tied.tied_out and (tied.opening_balance, tied.closing_balance) == (5400.0, 8000.0)


def test_shape_of_a_numbered_table(spark):
    body = ("Absa Bank statement\nAccount no. Bank\n0131883461 Absa Bank\nStatement period: January 1, 2026 to March 31, 2026\nAvailable balance Total debits Total credits\n"
            "KES 1,000.00 KES 250.00 KES 1,250.00\n# DATE NARRATION DEBIT CREDIT BALANCE")
    s = statements.shape(spark.createDataFrame([("f", body)], "file string, text string")).first()
    assert (s.layout, s.bank, s.account_no, s.currency, s.available_balance, s.total_debits, s.total_credits) == ("numbered_table", "absa", "0131883461", "KES", 1000.0, 250.0, 1250.0)
    assert (s.period_start, s.period_end) == ("January 1, 2026", "March 31, 2026")


def test_files_without_rows_get_a_placeholder(spark):
    df = spark.createDataFrame([("f", "nothing known"), ("g", "12/03/2024 PAY 1.00")], "file string, text string")
    got = {r.key: r.confidence for r in statements.ingest(df).collect()}
    assert got == {"bank:f:unmapped": 0.0, "bank:g:0": 1.0}


def _page(lines, page=1):
    return [("f", page, t, x, x + 10.0, top, top + 8.0) for top, words in lines for t, x in words]


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_positioned_table(spark, hot_rows):
    head = [("#", 10.0), ("DATE", 40.0), ("NARRATION", 120.0), ("DEBIT", 300.0), ("CREDIT", 400.0), ("BALANCE", 500.0)]
    one = _page([
        (10.0, [("Summary", 10.0), ("5.00", 300.0)]), (50.0, head), (70.0, [("early", 120.0)]),
        (90.0, [("1", 12.0), ("June", 40.0), ("2nd", 60.0), ("2022", 80.0), ("pay", 121.0), ("10.00", 402.0), ("110.00", 505.0)]),
        (110.0, [("more", 120.0)]), (130.0, [("2", 12.0), ("June", 40.0), ("nomoney", 120.0)]), (150.0, [("lead", 120.0)]),
        (170.0, [("3", 12.0), ("June", 40.0), ("3rd", 60.0), ("2022", 80.0), ("x", 121.0), ("4.00", 302.0), ("106.00", 505.0)]),
        (190.0, [("Page", 10.0), ("1", 40.0), ("of", 60.0), ("2", 80.0)]), (210.0, [("lost", 120.0)]),
    ])
    two = _page([(50.0, head), (70.0, [("4", 12.0), ("July", 40.0), ("1st", 60.0), ("2022", 80.0), ("y", 121.0), ("6.00", 302.0), ("100.00", 505.0)])], page=2)
    words = spark.createDataFrame(one + two, "file string, page int, text string, x0 double, x1 double, top double, bottom double").repartition(4)
    got = positioned.table_rows(words, hot_rows=hot_rows).orderBy("seq").collect()
    assert [(r.value_date, r.amount, r.direction, r.description, r.balance) for r in got] == [
        ("2022-06-02", 10.0, "in", "early pay more", 110.0), ("2022-06-03", 4.0, "out", "lead x", 106.0), ("2022-07-01", 6.0, "out", "y", 100.0)]
    raw = positioned.raw_table(words, hot_rows=hot_rows).orderBy("seq").collect()
    assert [(r["#"], r.NARRATION, r.DEBIT) for r in raw] == [("1", "early pay more", ""), ("2", "nomoney lead", ""), ("3", "x", "4.00"), ("4", "y", "6.00")]


def test_lines_of_crowded_and_large_pages(spark):
    rng = random.Random(5)
    rows = [("crowded", k % 3, f"w{k}", rng.choice([1.0, 2.0, 50.0]), 60.0, round(rng.uniform(0, 400), 1)) for k in range(900)]
    rows += [("large", 1, f"w{k}", float(k % 4), 9.0, float(k // 4 * 20)) for k in range(40_000)] + [("none", 1, "x", 1.0, 2.0, None)]
    df = spark.createDataFrame([(*r, None if r[5] is None else r[5] + 8.0) for r in rows], "file string, page int, text string, x0 double, x1 double, top double, bottom double")
    got = {(r.file, r.page, r.line_no): [w.text for w in r.words] for r in positioned.page_lines(df.repartition(4)).collect()}
    want = {}
    for file, page in {r[:2] for r in rows if r[5] is not None}:
        line_no, first, line = -1, None, []
        for r in sorted((r for r in rows if r[:2] == (file, page)), key=lambda r: (r[5], r[3], r[2])):
            if first is None or r[5] - first > 4.0:
                line_no, first, line = line_no + 1, r[5], []
                want[file, page, line_no] = line
            line.append((r[3], r[5], r[2]))
    assert got == {k: [t for _, _, t in sorted(v)] for k, v in want.items()}
    assert sum(k[0] == "large" for k in got) == 10_000


def test_tables_across_pages_are_stitched(spark):
    cells = [("f", 0, 0, ["Starting Balance", "1"]), ("f", 1, 0, ["Date", "", "Amount"]), ("f", 1, 1, ["d1", "a", "1"]), ("f", 1, 2, ["", "", ""]),
             ("f", 2, 0, ["Date", "", "Amount"]), ("f", 2, 1, ["d2", "b", "2", "extra"]), ("f", 3, 0, ["d3", "c", "3"])]
    df = spark.createDataFrame(cells, "file string, table_no int, row_no int, cells array<string>")
    got = [{p["column"]: p["value"] for p in r.row} for r in grids.stitch(df).orderBy("table_no", "row_no").collect()]
    assert got == [{"Date": "d1", "Column 2": "a", "Amount": "1"}, {"Date": "d2", "Column 2": "b", "Amount": "2", "Column 4": "extra"}, {"Date": "d3", "Column 2": "c", "Amount": "3"}]


def test_cash_maps(spark):
    free = "Borrower name: Lender X\n4.2 List accounts, describe its purpose, bank...\n[Account 7: template]\nAccount 1: Collections at Alpha Bank, daily.\nAccount 2: Payouts.\n4.3 Next\nAccount 9: no"
    doc = json.dumps({"narrative": {"borrower_name": "Y"}, "accounts": [{"id": "a", "label": "Main", "bank_name": "Beta", "currency": "KES", "purpose": {"value": ["pay", "tax"]}}, {"id": "b", "purpose": "one"}]})
    df = spark.createDataFrame([("x", "m.txt", free), ("y", "m.json", doc), ("z", "bad.json", "Account 1: only text")], "borrower string, file string, text string")
    parsed = cashmap.parse(df)
    assert {r.borrower: (r.borrower_name, r.source) for r in parsed.collect()} == {"x": ("Lender X", "free_text"), "y": ("Y", "structured_json"), "z": ("", "free_text")}
    rows = {(r.borrower, r.id): (r.bank_name, r.description) for r in cashmap.accounts(parsed).collect()}
    assert rows == {("x", "account_1"): ("Alpha Bank", "Collections at Alpha Bank, daily."), ("x", "account_2"): ("", "Payouts."), ("y", "a"): ("Beta", "Main — pay, tax"), ("y", "b"): ("", "b — one"), ("z", "account_1"): ("", "only text")}
    st = spark.createDataFrame([("x", "s1", "ALPHA BANK may"), ("x", "s2", "nobody")], "borrower string, file string, text string")
    got = sorted((r.account_ref, r.id) for r in cashmap.candidates(st, cashmap.accounts(parsed)).collect())
    assert got == [("s1", "account_1"), ("s2", "account_1"), ("s2", "account_2")]


def test_registry_documents(spark):
    doc = json.dumps({"data": {"plate": "P1", "vehicle": {"marca": "deep", "linea": "L", "modelo": 2019}, "list": [{"color": "red"}, {"color": "blue"}], "marca": "Top"}})
    df = spark.createDataFrame([("q1", "CO", doc), ("q2", "CO", "{}")], "plate string, country string, response string")
    got = {r.lookup: r for r in registry_json.canonical_records(df).collect()}
    assert (got["q1"].brand, got["q1"].model, got["q1"].year, got["q1"].color, got["q1"].plate) == ("Top", "L", "2019", "red", "P1") and got["q2"].brand == ""
    deep = "1"
    for _ in range(12):
        deep = '{"a":' + deep + "}"
    got = registry_json.leaves(spark.createDataFrame([("z", deep)], "plate string, response string")).collect()
    assert [(r.name, r.value) for r in got] == [("a", "1")]
    like = '{"color":"[metallic] red","status":"{ok","model":["x",{"year":2001}],"flag":true}'
    got = {r.name: r.value for r in registry_json.leaves(spark.createDataFrame([("z", like)], "plate string, response string")).collect()}
    assert got == {"color": "[metallic] red", "status": "{ok", "year": "2001", "flag": "true"}


def test_rates(spark):
    feed = spark.createDataFrame([('{"date":"2024-01-01","usd":{"kes":128.0,"bad":0}}',)], "json string")
    later = spark.createDataFrame([('{"date":"2024-01-02","usd":{"kes":129.0}}',), ('{"date":"2024-01-01","usd":{"kes":1.0}}',)], "json string")
    assert [(r.currency, r.rate) for r in fx.feed_rates(feed.unionByName(later)).collect()] == [("KES", 1 / 129)]
    live = fx.feed_rates(feed)
    both = fx.overlay_rates(live, fx.static_rates(spark, FxPolicy.from_mapping({"rates": {"kes": 1, "pen": 0.25}})))
    assert {r.currency: (r.rate, r.source) for r in both.collect()} == {"KES": (1 / 128, "live"), "PEN": (0.25, "static")}
    rows = spark.createDataFrame([(10.0, "kes "), (10.0, ""), (10.0, "usd"), (10.0, "zzz")], "amount double, currency string")
    got = [(r.amount_base, r.unmapped_currency) for r in fx.convert(rows, both).collect()]
    assert got == [(10 / 128, None), (10.0, None), (10.0, None), (10.0, "ZZZ")]


def test_category_order(spark):
    rules = category_rules(["acme"], ["fx", "tc"], ["payco"])
    pick = lambda t: _value(spark, normalize.category(F.col("c"), rules), c=t)
    assert [pick(t) for t in ("Acme op fx", "acme rent", "PayCo itf", "itf", "comision x", None)] == ["internal transfer", "other", "payment processor", "tax", "bank fee", "other"]


def test_totals_are_exact(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("amount_base"), F.lit("in").alias("direction"), F.lit(None).cast("string").alias("unmapped_currency"), F.lit("b").alias("borrower"))
    assert aggregate.cash_totals(df.repartition(7)).first().cash_in == 100.0


def test_logs_reports_and_csv(spark):
    root = tempfile.mkdtemp(prefix="tallyweave-store-")
    assert store.read_log(spark, f"{root}/log").count() == 0
    events = spark.createDataFrame([(1, "run_started", "r1")], "seq long, event string, run_id string")
    store.append_log(events, f"{root}/log")
    store.append_log(events.withColumn("ts", F.lit("2024-01-01T00:00:00")), f"{root}/log")
    assert sorted(r.ts is not None for r in store.read_log(spark, f"{root}/log").collect()) == [True, True]
    ex = spark.createDataFrame([("b", "b:anom:seqjump:1", "anomaly", "seqjump", 0.2)], "borrower string, id string, kind string, rule string, severity double")
    ev = spark.createDataFrame([("b", "b:anom:seqjump:1", "k")], "borrower string, exception_id string, evidence_key string")
    limits = Thresholds()
    header = store.report_header(spark.createDataFrame([("b", "r1")], "borrower string, run_id string"), ex, limits)
    for _ in range(2):  # a retried batch leaves one report
        store.write_report(header, ex, ev, f"{root}/report", limits, run="r1")
    back = store.read_reports(spark, f"{root}/report").first()
    assert store.read_reports(spark, f"{root}/report").count() == 1
    assert (back.borrower, back.exception_count, back.referral_count, back.forensic_count) == ("b", 1, 1, 0)
    store.export_csv(ex.withColumn("keys", F.array(F.lit("a"))), f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").first()["rule"] == "seqjump"


def test_inbox(spark):
    folder = _write(a__pdf="x", b__CSV="y", c__docx="z")
    got = tables.list_inbox(spark, folder).collect()
    assert sorted(r.name for r in got) == ["a.pdf", "b.CSV"] and all("@" in r.fingerprint for r in got)
