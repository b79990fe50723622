"""What every rule receives and returns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.operators.ordered import exact_median
from tallyweave.session import pin, settle


@dataclass(frozen=True)
class Findings:
    """Exceptions, and their evidence keys in long form."""

    exceptions: DataFrame
    evidence: DataFrame


@dataclass(frozen=True)
class Prepared:
    """Canonical rows with the rule amount, and the portfolio median per borrower for the rules that ask for it."""

    rows: DataFrame

    @cached_property
    def medians(self) -> DataFrame:
        """One number per borrower, computed at most once."""
        return pin(exact_median(self.rows, ["borrower"], "amt", "median_amt"))

    def with_median(self, rows: DataFrame | None = None) -> DataFrame:
        return (rows if rows is not None else self.rows).join(self.medians, "borrower")


def prepare(rows: DataFrame, amount: str | None = None, *, settled: bool = False) -> Prepared:
    """Rules look at the base-currency amount when the rows have one, else at the raw amount.

    The narrow rows are written once, since every rule scans them, some more than
    once; ``settled`` says the rows already are a table.
    """
    amount = amount or ("amount_base" if "amount_base" in rows.columns else "amount")
    lean = rows.select(
        F.coalesce(F.col("borrower"), F.lit("")).alias("borrower"), "key", "seq", "value_date", "direction",
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.trim(F.coalesce(F.col("account_ref"), F.lit(""))).alias("account_ref"),
        F.coalesce(F.col("sheet"), F.lit("")).alias("sheet"),
        F.coalesce(F.col(amount), F.lit(0.0)).alias("amt"),
    )
    lean = lean if settled else settle(lean)
    return Prepared(lean)


def exception_id(rule: str, suffix: Column) -> Column:
    """``<borrower>:anom:<rule>:<suffix>`` with a suffix that does not depend on row order."""
    return F.concat(F.col("borrower"), F.lit(f":anom:{rule}:"), suffix)


def single_row(hits: DataFrame, rule: str, severity: Column, description: Column) -> Findings:
    """One exception per row, its own key as evidence."""
    suffix = F.coalesce(F.col("key"), F.concat(F.lit("row-"), F.col("seq").cast("string")))
    exceptions = hits.select(
        "borrower", exception_id(rule, suffix).alias("id"), F.lit("anomaly").alias("kind"), F.lit(rule).alias("rule"),
        severity.cast("double").alias("severity"), description.alias("description"),
        F.when(F.col("key").isNotNull(), 1).otherwise(0).cast("long").alias("evidence_count"),
        F.col("key").alias("first_evidence"), F.lit("pending").alias("status"),
    )
    evidence = exceptions.filter(F.col("first_evidence").isNotNull()).select(
        "borrower", F.col("id").alias("exception_id"), F.col("first_evidence").alias("evidence_key")
    )
    return Findings(exceptions, evidence)
