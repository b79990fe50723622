"""One verification over any number of borrowers.

The stages are plain DataFrames; what several of them read (the transactions, the
totals per borrower, the unranked exceptions) is written once in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyweave.config import TapeColumns, Thresholds
from tallyweave.operators import aggregate, assets, fx, normalize, rank, reconcile, rules
from tallyweave.operators.rules import Findings
from tallyweave.session import settle


@dataclass(frozen=True)
class Inputs:
    """What a run starts from. ``balances``: borrower, account_ref, closing_balance, currency.
    ``register`` and ``registry``: pledged assets and what a registry says of them, one row per plate."""

    tape: DataFrame
    bank: DataFrame
    rates: DataFrame
    ledger: DataFrame | None = None
    mobile: DataFrame | None = None
    balances: DataFrame | None = None
    register: DataFrame | None = None
    registry: DataFrame | None = None


@dataclass(frozen=True)
class Verification:
    """The frames of a finished run."""

    transactions: DataFrame
    reported: DataFrame
    calculated: DataFrame
    pairs: DataFrame
    ready: DataFrame
    exceptions: DataFrame
    evidence: DataFrame
    spot_checks: DataFrame
    asset_coverage: DataFrame | None = None


def transactions(inputs: Inputs, columns: TapeColumns, periods: Sequence[str] = (), base: str = "USD") -> DataFrame:
    """Tape, ledger, mobile and bank rows in one schema and one currency."""
    parts = [normalize.tape_events(inputs.tape, columns), normalize.canonical(inputs.bank)]
    parts += [normalize.canonical(f) for f in (inputs.ledger, inputs.mobile) if f is not None]
    return fx.convert(normalize.in_periods(normalize.combine(*parts), periods), inputs.rates, base)


def both_sides(rows: DataFrame, balances: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reported, calculated, row counts) per borrower from one aggregation over all rows.

    Reported: the tape's collections and disbursements and the ledger's cash.
    Calculated: bank and mobile flows and the statements' closing balances.
    """
    amount = F.col("amount_base")
    tape, ledger, indep = (F.col("sheet") == "tape"), (F.col("sheet") == "ledger"), F.col("sheet").isin("bank", "mobile_money")
    inbound, outbound = F.col("direction") == "in", F.col("direction") == "out"
    t = aggregate.total
    g = rows.groupBy("borrower").agg(
        t(amount, tape & inbound).alias("rep_in"), t(amount, tape & outbound).alias("rep_out"), t(amount, ledger).alias("rep_cash"),
        t(amount, indep & inbound).alias("calc_in"), t(amount, indep & outbound).alias("calc_out"),
        F.count_if(tape).alias("tape_rows"), F.count_if(ledger).alias("ledger_rows"), F.count_if(indep).alias("independent_rows"),
    )
    if balances is not None:
        g = g.join(aggregate.closing_cash(balances, ["borrower"]).select("borrower", F.col("cash_total").alias("calc_cash"), F.col("statements").alias("balances")), "borrower", "left")
    else:
        g = g.withColumns({"calc_cash": F.lit(0.0), "balances": F.lit(0)})
    g = settle(g.fillna({"calc_cash": 0.0, "balances": 0}))

    def named(prefix: str) -> DataFrame:
        return g.select("borrower", F.col(f"{prefix}_in").alias("collections"), F.col(f"{prefix}_out").alias("disbursements"), F.col(f"{prefix}_cash").alias("cash_total"))

    return named("rep"), named("calc"), g.select("borrower", "tape_rows", "ledger_rows", "independent_rows", "balances")


def verify(
    inputs: Inputs, limits: Thresholds | None = None, columns: TapeColumns | None = None, *,
    periods: Sequence[str] = (), base: str = "USD",
) -> Verification:
    """Normalise, convert, aggregate, reconcile, look for anomalies, check assets and rank all findings together."""
    limits, columns = limits or Thresholds(), columns or TapeColumns()
    # Totals and seven rules scan the rows, so they are written once.
    rows = settle(transactions(inputs, columns, periods, base))
    balances = inputs.balances
    if balances is not None:
        balances = fx.convert(balances, inputs.rates, base, "closing_balance")
    reported, calculated, counts = both_sides(rows, balances)
    pairs = reconcile.side_by_side(reported, calculated, ["borrower"])
    ready = reconcile.readiness(counts)
    breaches = reconcile.only_ready(reconcile.reconcile(pairs, limits), ready)
    found: Findings = rules.detect(rows, limits, settled=True)
    unranked, evidence, covered = breaches.unionByName(found.exceptions), found.evidence, None
    if inputs.register is not None and inputs.registry is not None:
        missing = assets.verify(inputs.register, inputs.registry)
        unranked, evidence = unranked.unionByName(missing), evidence.unionByName(assets.evidence(missing))
        covered = assets.checked_coverage(inputs.register, inputs.registry)
    exceptions = rank.rank(settle(unranked))
    spot = normalize.flag_spot_checks(rows.filter(F.col("sheet") == "bank"), limits.pdf_confidence_floor)
    return Verification(
        rows, reported, calculated, reconcile.gateway_fee(pairs, limits), ready, exceptions, evidence,
        spot.filter("needs_spot_check").select("borrower", "key", "account_ref", "description", "confidence"), covered,
    )
