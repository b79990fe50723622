"""Registered queries: currency, totals, summaries, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.catalog.base import (
    CATEGORIES, COLUMNS, LIMITS, OUTSTANDING, OWED, PAID, PLAIN, Entry, all_rows, balances, bank, converted, money, rates, sql, tape_events,
)
from tallyweave.catalog.views import load, view
from tallyweave.operators import aggregate, fx, normalize, profile, reconcile
from tallyweave.operators.ordered import exact_median
from tallyweave.plans import verification

ENTRIES: dict[str, Entry] = {}


def bank_fx(s: SparkSession, d: str) -> DataFrame:
    return converted(s, d, bank(s, d))


def tape_fx(s: SparkSession, d: str) -> DataFrame:
    return converted(s, d, tape_events(s, d))


ENTRIES["fx_convert"] = Entry(
    lambda s, d: tape_fx(s, d).select("key", "amount", "currency_code", "amount_base", "unmapped_currency"),
    sql("SELECT key, amount, currency_code, amount_base, unmapped_currency FROM tape_fx"),
)
ENTRIES["fx_codes"] = Entry(
    lambda s, d: fx.currencies_to_fetch(normalize.combine(tape_events(s, d), bank(s, d))),
    sql("SELECT DISTINCT upper(trim(currency)) AS currency FROM (SELECT currency FROM tape_tx UNION ALL SELECT currency FROM bank_tx) x WHERE upper(trim(currency)) NOT IN ('', 'USD')"),
)
_TOTALS = f"""{money('amount_base', "direction='in'")} AS cash_in, {money('amount_base', "direction='out'")} AS cash_out, {money('amount_base')} AS cash_total,
  CAST(CAST(sum(CASE WHEN direction='in' THEN CAST(amount_base AS DECIMAL(28,10)) ELSE -CAST(amount_base AS DECIMAL(28,10)) END) AS DECIMAL(38,4)) AS DOUBLE) AS net_cash,
  {money('amount_base', 'unmapped_currency IS NOT NULL')} AS unconverted_total, count(*) AS transaction_count"""
ENTRIES["agg_cash_by_borrower"] = Entry(
    lambda s, d: aggregate.cash_totals(tape_fx(s, d)), sql(f"SELECT borrower, {_TOTALS} FROM tape_fx GROUP BY borrower")
)
ENTRIES["agg_cash_all_sources"] = Entry(
    lambda s, d: aggregate.cash_totals(all_rows(s, d), ["borrower", "sheet"]), sql(f"SELECT borrower, sheet, {_TOTALS} FROM all_fx GROUP BY borrower, sheet")
)
ENTRIES["agg_currencies"] = Entry(
    lambda s, d: aggregate.currencies(all_rows(s, d)).select("borrower", F.array_join("currencies_seen", ",").alias("seen"), F.array_join("unmapped_currencies", ",").alias("unmapped")),
    sql("""SELECT borrower, string_agg(DISTINCT nullif(currency_code, ''), ',' ORDER BY nullif(currency_code, '')) AS seen, string_agg(DISTINCT unmapped_currency, ',' ORDER BY unmapped_currency) AS unmapped FROM all_fx GROUP BY borrower"""),
)
_INOUT = f"""count(*) AS rows, {money('amount_base', "direction='in'")} AS total_in, {money('amount_base', "direction<>'in'")} AS total_out"""
ENTRIES["agg_by_statement"] = Entry(
    lambda s, d: aggregate.by_statement(bank_fx(s, d)), sql(f"SELECT coalesce(nullif(account_ref, ''), '?') AS statement, {_INOUT} FROM bank_fx GROUP BY 1")
)
_CATEGORY = """CASE WHEN upper(description) LIKE '%SIGNUP%' AND (upper(description) LIKE '%REF 1%' OR upper(description) LIKE '%REF 2%') THEN 'internal transfer'
 WHEN upper(description) LIKE '%PURCHASE%' THEN 'payment processor' WHEN upper(description) LIKE '%ITF%' THEN 'tax' WHEN upper(description) LIKE '%COMISI%' THEN 'bank fee' ELSE 'other' END"""
ENTRIES["agg_by_category"] = Entry(
    lambda s, d: aggregate.by_category(bank_fx(s, d), CATEGORIES).orderBy(F.desc(F.col("total_in") + F.col("total_out")), "category"),
    sql(f"SELECT {_CATEGORY} AS category, {_INOUT} FROM bank_fx GROUP BY 1"),
)
_MONTHS = ", ".join(
    [f"""{money('amount_base', f"{test} AND direction{op}'in'")} AS {side}_{way}""" for side, test in (("tape", "sheet='tape'"), ("bank", "sheet<>'tape'")) for way, op in (("in", "="), ("out", "<>"))]
)
ENTRIES["agg_by_month"] = Entry(
    lambda s, d: aggregate.by_month(converted(s, d, tape_events(s, d), bank(s, d)), keys=["borrower"]),
    sql(f"SELECT borrower, substring(value_date, 1, 7) AS month, {_MONTHS}, count(*) FILTER (sheet='tape') AS tape_rows, count(*) FILTER (sheet<>'tape') AS bank_rows FROM all_fx WHERE sheet <> 'ledger' GROUP BY 1, 2"),
)
ENTRIES["agg_statement_totals"] = Entry(
    lambda s, d: aggregate.statement_totals(bank_fx(s, d)),
    sql(f"SELECT statement, {_INOUT}, {money('amount_base')} AS cash_total FROM (SELECT *, coalesce(nullif(account_ref, ''), '?') AS statement FROM bank_fx) x GROUP BY ROLLUP (statement)"),
)
ENTRIES["agg_channel_totals"] = Entry(
    lambda s, d: aggregate.channel_totals(all_rows(s, d)), sql(f"SELECT sheet, {_INOUT} FROM all_fx GROUP BY sheet")
)
_BAL = "SELECT b.*, CASE WHEN upper(trim(b.currency)) IN ('', 'USD') OR r.rate IS NULL THEN closing_balance ELSE closing_balance * r.rate END AS amount_base, CASE WHEN upper(trim(b.currency)) NOT IN ('', 'USD') AND r.rate IS NULL THEN upper(trim(b.currency)) END AS unmapped_currency FROM balances b LEFT JOIN fx_rates r ON upper(trim(b.currency)) = r.currency"
ENTRIES["agg_closing_cash"] = Entry(
    lambda s, d: aggregate.closing_cash(fx.convert(balances(s, d), rates(s, d), amount="closing_balance"), ["borrower"]).withColumn("unmapped_currencies", F.array_join("unmapped_currencies", ",")),
    sql(f"SELECT borrower, {money('amount_base')} AS cash_total, count(*) AS statements, coalesce(string_agg(DISTINCT unmapped_currency, ',' ORDER BY unmapped_currency), '') AS unmapped_currencies FROM ({_BAL}) y GROUP BY borrower"),
)
_SUM_NAMES = {
    "principal_amount": PLAIN.format("principal_amount"), "total_loan_amount": PLAIN.format("total_loan_amount"),
    **{c: OWED.format(c) for c in ("principal_outstanding", "interest_outstanding", "fee_outstanding", "penalty_outstanding")},
    "total_outstanding": OUTSTANDING, "collected_to_date": PAID,
}
_SUMMARY = "SELECT borrower, count(loan_id) AS loan_count, " + ", ".join(f"{money(e)} AS {n}" for n, e in _SUM_NAMES.items()) + " FROM loan_tape GROUP BY borrower"
ENTRIES["agg_tape_summary"] = Entry(lambda s, d: aggregate.tape_summary(view(s, d, "loan_tape"), COLUMNS), sql(_SUMMARY))
_COHORTS = " UNION ALL ".join(f"SELECT borrower, '{c}' AS cohort, coalesce(nullif({c}, ''), '(blank)') AS value, count(*) AS loans FROM loan_tape GROUP BY 1, 2, 3" for c in ("status", "country", "product"))
ENTRIES["agg_cohort_counts"] = Entry(lambda s, d: aggregate.cohort_counts(view(s, d, "loan_tape")), sql(_COHORTS))
ENTRIES["agg_delinquency_bands"] = Entry(
    lambda s, d: aggregate.delinquency_bands(view(s, d, "loan_tape")),
    sql("""SELECT borrower, CASE WHEN x IS NULL THEN '(blank)' WHEN x <= 0 THEN '0' WHEN x <= 30 THEN '1-30' WHEN x <= 60 THEN '31-60' WHEN x <= 90 THEN '61-90' ELSE '>90' END AS band, count(*) AS loans
        FROM (SELECT borrower, CAST(days_past_due AS DOUBLE) AS x FROM loan_tape) t GROUP BY 1, 2"""),
)
ENTRIES["stat_portfolio_median"] = Entry(
    lambda s, d: exact_median(all_rows(s, d), ["borrower"], "amount_base", "median_amount"),
    sql("SELECT borrower, median(amount_base) AS median_amount FROM all_fx GROUP BY borrower"),
)
ENTRIES["stat_upper_median"] = Entry(
    lambda s, d: exact_median(bank(s, d), ["borrower", "account_ref"], "amount", "upper_median", which="upper"),
    sql("SELECT borrower, account_ref, list_sort(list(amount))[count(*) // 2 + 1] AS upper_median FROM bank_rows GROUP BY borrower, account_ref"),
)


def _cells(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "n/a").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("Amount"))


_CELLS = "SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders"
ENTRIES["agg_column_total"] = Entry(
    lambda s, d: aggregate.column_total(_cells(s, d), "Amount"), sql(f"SELECT {money('v')} AS total, count(v) AS parsed, count(*) - count(v) AS skipped FROM ({_CELLS}) c")
)
ENTRIES["agg_totals_check"] = Entry(
    lambda s, d: aggregate.totals_check(view(s, d, "loan_tape"), bank(s, d), "principal_amount", "amount", ["borrower"]),
    sql(f"""SELECT borrower, {money('r')} AS reported_total, {money('i')} AS independent_total,
        CAST(CAST(coalesce(sum(CAST(r AS DECIMAL(28,10))), 0) - coalesce(sum(CAST(i AS DECIMAL(28,10))), 0) AS DECIMAL(38,4)) AS DOUBLE) AS difference,
        abs(coalesce(sum(r), 0) - coalesce(sum(i), 0)) <= greatest(abs(coalesce(sum(r), 0)), abs(coalesce(sum(i), 0))) * 0.001 AS totals_match,
        count(r) AS reported_parsed, 0 AS reported_skipped, count(i) AS independent_parsed, 0 AS independent_skipped
        FROM (SELECT borrower, principal_amount AS r, NULL AS i FROM loan_tape UNION ALL SELECT borrower, NULL, amount FROM bank_rows) u GROUP BY borrower"""),
)
ENTRIES["cov_row_coverage"] = Entry(
    lambda s, d: aggregate.row_coverage(view(s, d, "ledger").unionByName(view(s, d, "ledger").withColumn("ledger_balance", F.when(F.col("seq") % 3 == 0, "-").otherwise(F.col("ledger_balance")))),
                                        normalize.simple_rows(view(s, d, "ledger").unionByName(view(s, d, "ledger").withColumn("ledger_balance", F.when(F.col("seq") % 3 == 0, "-").otherwise(F.col("ledger_balance")))), sheet="ledger")),
    sql("SELECT borrower, CAST(2 * count(*) - count(*) FILTER (seq % 3 = 0) AS BIGINT) AS rows_ingested, CAST(2 * count(*) AS BIGINT) AS population_size, round((2 * count(*) - count(*) FILTER (seq % 3 = 0)) * 100.0 / (2 * count(*)), 2) AS coverage_pct FROM ledger GROUP BY borrower"),
)

# Reconciliation --------------------------------------------------------------


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return verification.both_sides(all_rows(s, d), fx.convert(balances(s, d), rates(s, d), amount="closing_balance"))


def pairs(s: SparkSession, d: str) -> DataFrame:
    reported, calculated, _ = sides(s, d)
    return reconcile.side_by_side(reported, calculated, ["borrower"])


PAIRS = f"""SELECT borrower, rep_collections, calc_collections, rep_disbursements, calc_disbursements, rep_cash_total, coalesce(calc_cash_total, 0) AS calc_cash_total FROM (
 SELECT borrower, {money('amount_base', "sheet='tape' AND direction='in'")} AS rep_collections, {money('amount_base', "sheet IN ('bank','mobile_money') AND direction='in'")} AS calc_collections,
 {money('amount_base', "sheet='tape' AND direction='out'")} AS rep_disbursements, {money('amount_base', "sheet IN ('bank','mobile_money') AND direction='out'")} AS calc_disbursements,
 {money('amount_base', "sheet='ledger'")} AS rep_cash_total FROM all_fx GROUP BY borrower) f LEFT JOIN (SELECT borrower, {money('amount_base')} AS calc_cash_total FROM ({_BAL}) y GROUP BY borrower) c USING (borrower)"""
ENTRIES["recon_side_by_side"] = Entry(pairs, sql(PAIRS))


def _close_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs near the thresholds, one per nation: net of a small fee, equal, beyond, and against zero."""
    c = load(s, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("borrower"), (F.col("c_nationkey") % 5).alias("k")).agg(aggregate.total(F.abs("c_acctbal")).alias("x"))
    x, k = F.col("x"), F.col("k")
    return c.select(
        "borrower", x.alias("rep_collections"), F.when(k == 0, x * 0.97).when(k == 1, x).when(k == 2, x * 0.5).when(k == 3, 0.0).otherwise(x * 1.03).alias("calc_collections"),
        x.alias("rep_disbursements"), F.when(k == 0, x).when(k == 1, x + 50).when(k == 2, x * 1.2).when(k == 3, 0.0).otherwise(x + 200).alias("calc_disbursements"),
        F.when(k == 3, 0.0).otherwise(x).alias("rep_cash_total"), F.when(k == 3, 0.0).when(k == 1, x * 1.005).otherwise(x * 1.02).alias("calc_cash_total"),
    )


_CLOSE = f"""SELECT borrower, x AS rep_collections, CASE k WHEN 0 THEN x * 0.97 WHEN 1 THEN x WHEN 2 THEN x * 0.5 WHEN 3 THEN 0 ELSE x * 1.03 END AS calc_collections, x AS rep_disbursements,
 CASE k WHEN 0 THEN x WHEN 1 THEN x + 50 WHEN 2 THEN x * 1.2 WHEN 3 THEN 0 ELSE x + 200 END AS calc_disbursements, CASE WHEN k = 3 THEN 0 ELSE x END AS rep_cash_total, CASE k WHEN 3 THEN 0 WHEN 1 THEN x * 1.005 ELSE x * 1.02 END AS calc_cash_total
 FROM (SELECT concat('n', CAST(c_nationkey AS VARCHAR)) AS borrower, c_nationkey % 5 AS k, {money('abs(c_acctbal)')} AS x FROM customer GROUP BY 1, 2) c"""
_GAP = "CASE WHEN {c} = 0 THEN CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END ELSE abs({r} - {c}) / abs({c}) END"
_GC, _GD, _GT = (_GAP.format(r=f"rep_{m}", c=f"calc_{m}") for m in ("collections", "disbursements", "cash_total"))
_PLAUSIBLE = "(rep_collections <> 0 AND (rep_collections - calc_collections) / rep_collections > 0 AND (rep_collections - calc_collections) / rep_collections <= 0.05)"


def pct(e: str) -> str:
    return f"CASE WHEN isinf({e}) THEN 'inf%' ELSE concat(format('{{:.1f}}', {e} * 100), '%') END"


def num(e: str) -> str:
    return f"format('{{:,.2f}}', {e})"


def breaches(source: str) -> str:
    return f"""
SELECT borrower, concat(borrower, ':recon:collections') AS id, 'recon:collections' AS rule, least(1.0, {_GC}) AS severity,
  concat('Collections variance ', {pct(_GC)}, ' exceeds 2% (reported=', {num('rep_collections')}, ', calculated=', {num('calc_collections')}, ')') AS description FROM ({source}) p WHERE {_GC} > 0.02 AND NOT {_PLAUSIBLE}
UNION ALL SELECT borrower, concat(borrower, ':recon:disbursements'), 'recon:disbursements', least(1.0, {_GD}),
  concat('Disbursement variance ', {num('abs(rep_disbursements - calc_disbursements)')}, ' ($100 abs) or ', {pct(_GD)}, ' (> 5%) (reported=', {num('rep_disbursements')}, ', calculated=', {num('calc_disbursements')}, ')') FROM ({source}) p WHERE abs(rep_disbursements - calc_disbursements) > 100 OR {_GD} > 0.05
UNION ALL SELECT borrower, concat(borrower, ':recon:cash'), 'recon:cash', least(1.0, {_GT}),
  concat('Cash balance variance ', {pct(_GT)}, ' exceeds 1% (ledger=', {num('rep_cash_total')}, ', statement=', {num('calc_cash_total')}, ')') FROM ({source}) p WHERE {_GT} > 0.01"""


_EXC = ("borrower", "id", "rule", "severity", "description")
ENTRIES["recon_exceptions"] = Entry(lambda s, d: reconcile.reconcile(pairs(s, d), LIMITS).select(*_EXC), sql(breaches("pairs"), pairs=PAIRS))
ENTRIES["recon_thresholds"] = Entry(lambda s, d: reconcile.reconcile(_close_pairs(s, d), LIMITS).select(*_EXC), sql(breaches("pairs"), pairs=_CLOSE))
for _metric in ("collections", "disbursements", "cash"):
    ENTRIES[f"recon_{_metric}"] = Entry(
        lambda s, d, m=_metric: reconcile.reconcile(_close_pairs(s, d), LIMITS).filter(F.col("rule") == f"recon:{m}").select(*_EXC),
        sql(f"SELECT * FROM ({breaches('pairs')}) b WHERE rule = 'recon:{_metric}'", pairs=_CLOSE),
    )
ENTRIES["recon_watch_threshold"] = Entry(
    lambda s, d: reconcile.reconcile(_close_pairs(s, d), LIMITS.with_cash_variance(0.0001)).filter(F.col("rule") == "recon:cash").select("borrower", "severity"),
    sql(f"SELECT borrower, least(1.0, {_GT}) AS severity FROM pairs WHERE {_GT} > 0.0001", pairs=_CLOSE),
)
ENTRIES["recon_gateway_fee"] = Entry(
    lambda s, d: reconcile.gateway_fee(_close_pairs(s, d), LIMITS).select("borrower", "estimated_gateway_fee", "estimated_gateway_fee_pct", "fee_plausible"),
    sql(f"""SELECT borrower, CASE WHEN rep_collections > calc_collections THEN round(rep_collections - calc_collections, 2) ELSE 0 END AS estimated_gateway_fee,
        CASE WHEN rep_collections > calc_collections THEN round((rep_collections - calc_collections) / rep_collections, 4) ELSE 0 END AS estimated_gateway_fee_pct, {_PLAUSIBLE} AS fee_plausible FROM pairs""", pairs=_CLOSE),
)


def _gated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Counts per nation with some sides missing, beside the close pairs."""
    counts = _close_pairs(s, d).select("borrower", F.substring("borrower", 2, 9).cast("int").alias("n")).select(
        "borrower", (F.col("n") % 2).alias("tape_rows"), (F.col("n") % 3).alias("ledger_rows"), (F.col("n") % 5).alias("independent_rows"), (F.col("n") % 7).alias("balances")
    )
    return reconcile.readiness(counts), _close_pairs(s, d)


_N = "CAST(substring(borrower, 2) AS INTEGER)"
ENTRIES["recon_readiness"] = Entry(
    lambda s, d: _gated(s, d)[0].withColumn("skipped", F.array_join("skipped", ",")),
    sql(f"""SELECT borrower, {_N} % 2 > 0 AND {_N} % 5 > 0 AS collections_ready, {_N} % 2 > 0 AND {_N} % 5 > 0 AS disbursements_ready, {_N} % 3 > 0 AND {_N} % 7 > 0 AS cash_ready,
        concat_ws(',', CASE WHEN NOT ({_N} % 2 > 0 AND {_N} % 5 > 0) THEN 'collections,disbursements' END, CASE WHEN NOT ({_N} % 3 > 0 AND {_N} % 7 > 0) THEN 'cash' END) AS skipped FROM pairs""", pairs=_CLOSE),
)
ENTRIES["recon_gated"] = Entry(
    lambda s, d: reconcile.only_ready(reconcile.reconcile(_gated(s, d)[1], LIMITS), _gated(s, d)[0]).select("id", "severity"),
    sql(f"""SELECT id, severity FROM ({breaches('pairs')}) b WHERE CASE WHEN rule = 'recon:cash' THEN {_N} % 3 > 0 AND {_N} % 7 > 0 ELSE {_N} % 2 > 0 AND {_N} % 5 > 0 END""", pairs=_CLOSE),
)


def _sides(s: SparkSession, d: str) -> DataFrame:
    """Watch mode, with one borrower's statements missing and one borrower's figures supplied."""
    tape = aggregate.cash_totals(tape_fx(s, d))
    b = aggregate.cash_totals(bank_fx(s, d).withColumn("borrower", F.when(F.col("borrower") == "BUILDING", "OTHER").otherwise(F.col("borrower"))))
    given = tape.filter(F.col("borrower") == "FURNITURE").select("borrower", F.lit(1.0).alias("collections"), F.lit(2.0).alias("disbursements"), F.lit(3.0).alias("cash_total"))
    return reconcile.choose_sides(tape, b, given)


ENTRIES["recon_choose_sides"] = Entry(
    _sides,
    sql("""SELECT t.borrower, CASE WHEN t.borrower = 'FURNITURE' THEN 1.0 ELSE t.cash_in END AS rep_collections, coalesce(b.cash_in, t.cash_in) AS calc_collections,
        CASE WHEN t.borrower = 'FURNITURE' THEN 2.0 ELSE t.cash_out END AS rep_disbursements, coalesce(b.cash_out, t.cash_out) AS calc_disbursements,
        CASE WHEN t.borrower = 'FURNITURE' THEN 3.0 ELSE t.cash_total END AS rep_cash_total, coalesce(b.cash_total, t.cash_total) AS calc_cash_total,
        b.borrower IS NOT NULL AS independent_source_present, CASE WHEN b.borrower IS NULL THEN 'NOT VERIFIED' ELSE 'verified against independent statements' END AS reconciliation_scope
        FROM t LEFT JOIN b ON t.borrower = b.borrower AND t.borrower <> 'BUILDING'""",
        t=f"SELECT borrower, {_TOTALS} FROM tape_fx GROUP BY borrower", b=f"SELECT borrower, {_TOTALS} FROM bank_fx GROUP BY borrower"),
)

# Profile ---------------------------------------------------------------------


def _audit(s: SparkSession, d: str) -> DataFrame:
    tape = view(s, d, "loan_tape")
    have = tape.select("borrower").distinct().select("borrower", F.explode(F.array(*[F.lit(c) for c in tape.columns])).alias("column"))
    return profile.schema_audit(have.filter(~((F.col("borrower") == "BUILDING") & (F.col("column") == "fee_outstanding"))))


ENTRIES["prof_schema_audit"] = Entry(
    _audit,
    sql("""SELECT borrower, field, field AS column, NOT (borrower = 'BUILDING' AND field = 'fee_outstanding') AS present FROM (SELECT DISTINCT borrower FROM loan_tape) b CROSS JOIN (SELECT unnest(['loan_id','principal_amount','total_loan_amount','principal_outstanding','interest_outstanding','fee_outstanding','penalty_outstanding']) AS field) f"""),
)
_PROFILED = ("closure_date", "company_due_date", "currency", "country", "product", "days_past_due")
ENTRIES["prof_population"] = Entry(
    lambda s, d: profile.population(view(s, d, "loan_tape"), _PROFILED),
    sql(" UNION ALL ".join(f"SELECT borrower, count(*) AS rows, '{f}' AS field, count(nullif(trim({f}), '')) AS populated, round(count(nullif(trim({f}), '')) * 100.0 / count(*), 2) AS populated_pct FROM loan_tape GROUP BY borrower" for f in _PROFILED)),
)


def _sanity(s: SparkSession, d: str) -> DataFrame:
    """Tapes read without the sign convention and with loans shrunk for one borrower; one empty tape."""
    t = view(s, d, "loan_tape").withColumn("total_loan_amount", F.when(F.col("borrower") == "BUILDING", F.col("total_loan_amount") * 0.1).when(F.col("borrower") == "HOUSEHOLD", -F.col("total_loan_amount")).otherwise(F.col("total_loan_amount")))
    cohorts = aggregate.cohort_counts(t).filter(~((F.col("borrower") == "FURNITURE") & (F.col("cohort") == "status") & (F.col("value") == "P")))
    listed = t.select("borrower").distinct().unionByName(s.createDataFrame([("EMPTY",)], "borrower string"))
    return profile.sanity(aggregate.tape_summary(t, COLUMNS), cohorts, listed)


ENTRIES["prof_sanity"] = Entry(
    _sanity,
    sql("""SELECT 'BUILDING' AS borrower, 'outstanding_exceeds_loans' AS finding UNION ALL SELECT 'HOUSEHOLD', 'negative_total' UNION ALL SELECT 'HOUSEHOLD', 'outstanding_exceeds_loans' UNION ALL SELECT 'FURNITURE', 'cohorts_do_not_add_up' UNION ALL SELECT 'EMPTY', 'empty_tape'"""),
)
