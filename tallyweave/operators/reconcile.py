"""Reported against calculated figures, under fixed thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.config import Thresholds
from tallyweave.functions.text import percent, thousands

METRICS = ("collections", "disbursements", "cash_total")


def relative_gap(reported: Column, calculated: Column) -> Column:
    """|reported - calculated| / |calculated|; zero against zero is 0, against anything else infinite."""
    return F.when(
        calculated == 0, F.when(reported == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    ).otherwise(F.try_divide(F.abs(reported - calculated), F.abs(calculated)))


def side_by_side(reported: DataFrame, calculated: DataFrame, keys: list[str]) -> DataFrame:
    """Reported and calculated metrics per borrower, prefixed ``rep_`` and ``calc_``; a missing figure counts as 0."""
    r = reported.select(*keys, *[F.col(m).alias(f"rep_{m}") for m in METRICS])
    c = calculated.select(*keys, *[F.col(m).alias(f"calc_{m}") for m in METRICS])
    both = r.join(c, keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"{p}_{m}"), F.lit(0.0)).alias(f"{p}_{m}") for m in METRICS for p in ("rep", "calc")])


def gateway_fee(pairs: DataFrame, limits: Thresholds) -> DataFrame:
    """A net amount short of the gross by a small share is explained as a payment fee, on its own line."""
    gap = F.col("rep_collections") - F.col("calc_collections")
    share = F.coalesce(F.try_divide(gap, F.nullif(F.col("rep_collections"), F.lit(0.0))), F.lit(0.0))
    return (
        pairs.withColumn("estimated_gateway_fee", F.when(gap > 0, F.round(gap, 2)).otherwise(F.lit(0.0)))
        .withColumn("estimated_gateway_fee_pct", F.when(gap > 0, F.round(share, 4)).otherwise(F.lit(0.0)))
        .withColumn("fee_plausible", (share > 0) & (share <= limits.gateway_fee_max_pct))
    )


def reconcile(pairs: DataFrame, limits: Thresholds, run: Column | None = None) -> DataFrame:
    """Exceptions for every breached threshold, at most three per borrower, in one pass."""
    run = run if run is not None else F.col("borrower")
    p = gateway_fee(pairs, limits)
    rc, cc = F.col("rep_collections"), F.col("calc_collections")
    rd, cd = F.col("rep_disbursements"), F.col("calc_disbursements")
    rt, ct = F.col("rep_cash_total"), F.col("calc_cash_total")
    col_var, disb_pct, cash_var = relative_gap(rc, cc), relative_gap(rd, cd), relative_gap(rt, ct)
    disb_abs = F.abs(rd - cd)

    def finding(rule: str, hit: Column, measure: Column, text: Column) -> Column:
        return F.when(
            hit,
            F.struct(
                F.concat(run, F.lit(f":recon:{rule}")).alias("id"),
                F.lit("reconciliation").alias("kind"),
                F.lit(f"recon:{rule}").alias("rule"),
                F.least(F.lit(1.0), measure).alias("severity"),
                text.alias("description"),
            ),
        )

    def figures(first: str, a: Column, second: str, b: Column) -> list[Column]:
        return [F.lit(f"({first}="), thousands(a, 2), F.lit(f", {second}="), thousands(b, 2), F.lit(")")]

    findings = F.array(
        finding(
            "collections", (col_var > limits.collections_variance) & ~F.col("fee_plausible"), col_var,
            F.concat(F.lit("Collections variance "), percent(col_var, 1),
                     F.lit(f" exceeds {limits.collections_variance:.0%} "), *figures("reported", rc, "calculated", cc)),
        ),
        finding(
            "disbursements", (disb_abs > limits.disbursement_abs) | (disb_pct > limits.disbursement_pct), disb_pct,
            F.concat(F.lit("Disbursement variance "), thousands(disb_abs, 2),
                     F.lit(f" (${limits.disbursement_abs:,.0f} abs) or "), percent(disb_pct, 1),
                     F.lit(f" (> {limits.disbursement_pct:.0%}) "), *figures("reported", rd, "calculated", cd)),
        ),
        finding(
            "cash", cash_var > limits.cash_balance_variance, cash_var,
            F.concat(F.lit("Cash balance variance "), percent(cash_var, 1),
                     F.lit(f" exceeds {limits.cash_balance_variance:.0%} "), *figures("ledger", rt, "statement", ct)),
        ),
    )
    each = p.select("borrower", F.explode(F.filter(findings, lambda f: f.isNotNull())).alias("f"))
    return each.select(
        "borrower", "f.*", F.lit(0).cast("long").alias("evidence_count"),
        F.lit(None).cast("string").alias("first_evidence"), F.lit("pending").alias("status"),
    )


def readiness(counts: DataFrame) -> DataFrame:
    """Which checks have both sides present, and which are skipped.

    ``counts`` has per borrower ``tape_rows, ledger_rows, independent_rows, balances``.
    """
    both = (F.col("tape_rows") > 0) & (F.col("independent_rows") > 0)
    cash = (F.col("ledger_rows") > 0) & (F.col("balances") > 0)
    names = [("collections", both), ("disbursements", both), ("cash", cash)]
    skipped = F.filter(F.array(*[F.when(~ok, F.lit(n)) for n, ok in names]), lambda x: x.isNotNull())
    return counts.select("borrower", *[ok.alias(f"{n}_ready") for n, ok in names], skipped.alias("skipped"))


def only_ready(exceptions: DataFrame, ready: DataFrame) -> DataFrame:
    """Drop reconciliation findings whose evidence is not there yet."""
    flags = F.create_map(*[x for n in ("collections", "disbursements", "cash") for x in (F.lit(f"recon:{n}"), F.col(f"{n}_ready"))])
    ok = ready.select("borrower", flags.alias("_ready"))
    return (
        exceptions.join(ok, "borrower", "left")
        .filter(F.coalesce(F.try_element_at(F.col("_ready"), F.col("rule")), F.lit(True)))
        .drop("_ready")
    )


def choose_sides(tape: DataFrame, bank: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """Watch mode: bank totals when a borrower has bank rows, else the tape against itself, marked NOT VERIFIED.

    ``tape`` and ``bank`` are cash totals per borrower; ``supplied`` overrides the reported side.
    """

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("borrower", F.col("cash_in").alias(f"{prefix}_collections"),
                         F.col("cash_out").alias(f"{prefix}_disbursements"),
                         F.col("cash_total").alias(f"{prefix}_cash_total"),
                         F.col("transaction_count").alias(f"{prefix}_rows"))

    both = named(tape, "tape").join(named(bank, "bank"), "borrower", "left")
    if supplied is not None:
        both = both.join(supplied.select("borrower", *[F.col(m).alias(f"given_{m}") for m in METRICS]), "borrower", "left")
    verified = F.coalesce(F.col("bank_rows"), F.lit(0)) > 0
    out = []
    for m in METRICS:
        given = [F.col(f"given_{m}")] if supplied is not None else []
        out.append(F.coalesce(*given, F.col(f"tape_{m}")).alias(f"rep_{m}"))
        out.append(F.when(verified, F.col(f"bank_{m}")).otherwise(F.col(f"tape_{m}")).alias(f"calc_{m}"))
    scope = F.when(verified, F.lit("verified against independent statements")).otherwise(F.lit("NOT VERIFIED"))
    return both.select("borrower", *out, verified.alias("independent_source_present"), scope.alias("reconciliation_scope"))


