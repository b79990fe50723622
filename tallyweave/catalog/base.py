"""Shared pieces of the registered queries and their checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.catalog.views import check_sql, view
from tallyweave.config import FxPolicy, TapeColumns, Thresholds, category_rules
from tallyweave.operators import fx, normalize

LIMITS = Thresholds()
COLUMNS = TapeColumns(negative_sign_borrowers=frozenset({"MACHINERY"}))
POLICY = FxPolicy(rates={"KES": 0.0078125, "PEN": 0.25, "NGN": 0.000625})
CATEGORIES = category_rules(treasury_names=["signup"], treasury_tokens=["REF 1", "REF 2"], processors=["purchase"])

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    check: str | None = None


def tape_events(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.tape_events(view(spark, sf, "loan_tape"), COLUMNS)


def bank(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.canonical(view(spark, sf, "bank_rows"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.simple_rows(view(spark, sf, "ledger"), sheet="ledger")


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_rates")


def converted(spark: SparkSession, sf: str, *frames: DataFrame) -> DataFrame:
    return fx.convert(normalize.combine(*frames), rates(spark, sf))


def all_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tape, ledger and bank rows in base currency."""
    return converted(spark, sf, tape_events(spark, sf), ledger(spark, sf), bank(spark, sf))


def balances(spark: SparkSession, sf: str) -> DataFrame:
    """A closing balance per account, as its statements would state it."""
    signed = F.when(F.col("direction") == "in", F.col("amount")).otherwise(-F.col("amount")).cast("decimal(18,4)")
    return (
        bank(spark, sf).groupBy("borrower", "account_ref")
        .agg(F.sum(signed).cast("double").alias("closing_balance"), F.max("currency").alias("currency"))
    )


# The same steps in SQL.
OWED = """(CASE WHEN borrower='MACHINERY' THEN abs({0}) ELSE greatest({0}, 0) END)"""
PLAIN = """(CASE WHEN borrower='MACHINERY' THEN abs({0}) ELSE {0} END)"""
OUTSTANDING = "(" + " + ".join(OWED.format(c) for c in ("principal_outstanding", "interest_outstanding", "fee_outstanding", "penalty_outstanding")) + ")"
PAID = f"greatest(0, {PLAIN.format('total_loan_amount')} - {OUTSTANDING})"

CTES: dict[str, str] = {}
CTES["tape_tx"] = f"""
SELECT borrower, concat('tape:', borrower, ':', loan_id, ':disb') AS key, 'tape' AS sheet, begin_date AS value_date, abs(principal_amount) AS amount,
       'out' AS direction, currency, concat('disbursement:', loan_id) AS description, borrower AS account_ref, seq * 2 AS seq
FROM loan_tape WHERE principal_amount <> 0 AND begin_date IS NOT NULL
UNION ALL
SELECT borrower, concat('tape:', borrower, ':', loan_id, ':coll'), 'tape', coalesce(closure_date, company_due_date, begin_date), {PAID},
       'in', currency, concat('collections:', loan_id), borrower, seq * 2 + 1
FROM loan_tape WHERE {PAID} <> 0 AND coalesce(closure_date, company_due_date, begin_date) IS NOT NULL
"""
CTES["ledger_tx"] = """
SELECT borrower, concat('ledger:ledger:', CAST(seq AS VARCHAR)) AS key, 'ledger' AS sheet, as_of AS value_date, abs(CAST(ledger_balance AS DOUBLE)) AS amount,
       CASE WHEN CAST(ledger_balance AS DOUBLE) >= 0 THEN 'in' ELSE 'out' END AS direction, currency, account AS description, account_ref, seq
FROM ledger
"""
CTES["bank_tx"] = "SELECT borrower, key, sheet, value_date, amount, direction, currency, description, account_ref, seq FROM bank_rows"
CTES["all_tx"] = "SELECT * FROM tape_tx UNION ALL SELECT * FROM ledger_tx UNION ALL SELECT * FROM bank_tx"

_CONVERT = """
SELECT t.*, upper(trim(t.currency)) AS currency_code,
       CASE WHEN upper(trim(t.currency)) IN ('', 'USD') OR r.rate IS NULL THEN t.amount ELSE t.amount * r.rate END AS amount_base,
       CASE WHEN upper(trim(t.currency)) NOT IN ('', 'USD') AND r.rate IS NULL THEN upper(trim(t.currency)) END AS unmapped_currency
FROM {0} t LEFT JOIN fx_rates r ON upper(trim(t.currency)) = r.currency
"""
CTES["tape_fx"] = _CONVERT.format("tape_tx")
CTES["bank_fx"] = _CONVERT.format("bank_tx")
CTES["all_fx"] = _CONVERT.format("all_tx")
CTES["balances"] = """
SELECT borrower, account_ref, CAST(sum(CAST(CASE WHEN direction='in' THEN amount ELSE -amount END AS DECIMAL(18,4))) AS DOUBLE) AS closing_balance, max(currency) AS currency
FROM bank_rows GROUP BY borrower, account_ref
"""

_USES = {"all_tx": ("tape_tx", "ledger_tx", "bank_tx"), "tape_fx": ("tape_tx",), "bank_fx": ("bank_tx",), "all_fx": ("tape_tx", "ledger_tx", "bank_tx", "all_tx")}


def money(expr: str, where: str | None = None) -> str:
    """Exact sum of an amount, as the operators round it."""
    cell = f"CAST(coalesce({expr}, 0) AS DECIMAL(28,10))"
    if where:
        cell = f"CASE WHEN {where} THEN {cell} ELSE 0 END"
    return f"CAST(CAST(coalesce(sum({cell}), 0) AS DECIMAL(38,4)) AS DOUBLE)"


def sql(body: str, **extra: str) -> str:
    """A check text with every shared step it mentions."""
    whole = " ".join([*extra.values(), body])
    ctes: dict[str, str] = {}
    for name in CTES:
        if name in whole.replace("(", " ").replace(")", " ").replace(",", " ").split():
            for need in (*_USES.get(name, ()), name):
                ctes.setdefault(need, CTES[need])
    ordered = {n: ctes[n] for n in CTES if n in ctes}
    return check_sql(body, **ordered, **extra)
