"""Independent totals, breakdowns and tape summaries (hash aggregates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.config import CategoryRule, TapeColumns
from tallyweave.functions.dates import month_key
from tallyweave.functions.money import exact_sum, parse_amount, to_double, total
from tallyweave.functions.text import strip
from tallyweave.operators.normalize import category, with_money
from tallyweave.schema import DIR_IN, DIR_OUT


def _in() -> Column:
    return F.col("direction") == DIR_IN


def cash_totals(rows: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Inflow, outflow and gross totals in base currency, one row per key.

    ``cash_total`` adds both directions; ``net_cash`` subtracts them. Amounts that
    had no rate are added unconverted and shown on their own.
    """
    amount = F.col("amount_base")
    return rows.groupBy(*keys).agg(
        total(amount, _in()).alias("cash_in"),
        total(amount, F.col("direction") == DIR_OUT).alias("cash_out"),
        total(amount).alias("cash_total"),
        to_double(exact_sum(amount, _in()) - exact_sum(amount, F.col("direction") == DIR_OUT)).alias("net_cash"),
        total(amount, F.col("unmapped_currency").isNotNull()).alias("unconverted_total"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def currencies(rows: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Sorted distinct currency codes seen and unmapped, one row per key."""
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.nullif(F.col("currency_code"), F.lit("")))).alias("currencies_seen"),
        F.array_sort(F.collect_set("unmapped_currency")).alias("unmapped_currencies"),
    )


def _in_out(amount: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        total(amount, _in()).alias("total_in"),
        total(amount, F.coalesce(~_in(), F.lit(True))).alias("total_out"),
    ]


def by_statement(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, in and out per statement; anything not inbound counts as out."""
    ref = F.coalesce(F.nullif(F.col("account_ref"), F.lit("")), F.lit("?"))
    return rows.withColumn("statement", ref).groupBy(*keys, "statement").agg(*_in_out(F.col("amount_base")))


def by_category(rows: DataFrame, rules: Sequence[CategoryRule], keys: Sequence[str] = ()) -> DataFrame:
    return (
        rows.withColumn("category", category(F.col("description"), rules))
        .groupBy(*keys, "category")
        .agg(*_in_out(F.col("amount_base")))
    )


def by_month(rows: DataFrame, tape_sheet: str = "tape", keys: Sequence[str] = ()) -> DataFrame:
    """Six measures per month, tape beside bank, by conditional aggregation."""
    amount = F.col("amount_base")
    tape = F.col("sheet") == tape_sheet
    out = F.coalesce(~_in(), F.lit(True))
    return (
        rows.withColumn("month", month_key(F.col("value_date")))
        .groupBy(*keys, "month")
        .agg(
            total(amount, tape & _in()).alias("tape_in"),
            total(amount, tape & out).alias("tape_out"),
            total(amount, ~tape & _in()).alias("bank_in"),
            total(amount, ~tape & out).alias("bank_out"),
            F.count_if(tape).alias("tape_rows"),
            F.count_if(~tape).alias("bank_rows"),
        )
    )


def statement_totals(rows: DataFrame) -> DataFrame:
    """Per statement and over all of them, in one pass (rollup); the grand total has a null statement."""
    ref = F.coalesce(F.nullif(F.col("account_ref"), F.lit("")), F.lit("?"))
    return (
        rows.withColumn("statement", ref)
        .rollup("statement")
        .agg(*_in_out(F.col("amount_base")), total(F.col("amount_base")).alias("cash_total"))
    )


def channel_totals(rows: DataFrame) -> DataFrame:
    """Totals per source channel (bank, mobile money, ledger, tape)."""
    return rows.groupBy("sheet").agg(*_in_out(F.col("amount_base")))


def closing_cash(balances: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cash from converted closing balances, over the statements that have one."""
    have = balances.filter(F.col("closing_balance").isNotNull())
    aggs = [
        total(F.col("amount_base")).alias("cash_total"),
        F.count(F.lit(1)).alias("statements"),
        F.array_sort(F.collect_set("unmapped_currency")).alias("unmapped_currencies"),
    ]
    return have.groupBy(*keys).agg(*aggs) if keys else have.agg(*aggs)


def statement_summaries(rows: DataFrame, balances: DataFrame, shapes: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per statement: totals, closing balance, declared shape, candidate accounts.

    Statements are those of ``shapes`` and those that rows name. One without rows
    has totals of 0; rows without an account are a statement of their own under a blank name.
    """
    # A statement has at most as many candidates as its cash map lists accounts.
    names = candidates.groupBy("account_ref").agg(F.array_sort(F.collect_set("label")).alias("candidate_accounts"))
    named = rows.withColumn("account_ref", F.coalesce("account_ref", F.lit("")))
    totals = cash_totals(named, ["account_ref"]).select("account_ref", "cash_in", "cash_out", "transaction_count")
    declared = shapes.select("account_ref", "layout", "bank", "account_no", F.col("currency").alias("declared_currency"))
    zero = {"cash_in": F.coalesce("cash_in", F.lit(0.0)), "cash_out": F.coalesce("cash_out", F.lit(0.0)), "transaction_count": F.coalesce("transaction_count", F.lit(0).cast("long"))}
    return (
        totals.join(declared, "account_ref", "full").withColumns(zero)
        .join(balances.select("account_ref", "closing_balance"), "account_ref", "left")
        .join(names, "account_ref", "left")
    )


def tape_summary(tape: DataFrame, config: TapeColumns | None = None, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Loan count and money totals of a tape; what was collected is floored per loan."""
    money = with_money(tape, config or TapeColumns()).withColumnRenamed("paid", "collected_to_date")
    names = ["principal_amount", "total_loan_amount", "principal_outstanding", "interest_outstanding",
             "fee_outstanding", "penalty_outstanding", "total_outstanding", "collected_to_date"]
    return money.groupBy(*keys).agg(F.count("loan_id").alias("loan_count"), *[total(F.col(n)).alias(n) for n in names])


def cohort_counts(tape: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Loan counts by status, country and product, in one pass (grouping sets)."""

    def shown(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("(blank)")).alias(name)

    dims = ["status", "country", "product"]
    base = tape.select(*keys, *[shown(d) for d in dims])
    sets = [[F.col(k) for k in keys] + [F.col(d)] for d in dims]
    grouped = base.groupingSets(sets, *keys, *dims).agg(
        F.count(F.lit(1)).alias("loans"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    cohort = F.when(F.col("_g_status") == 0, "status").when(F.col("_g_country") == 0, "country").otherwise("product")
    return grouped.select(
        *keys, cohort.alias("cohort"), F.coalesce(*[F.col(d) for d in dims]).alias("value"), "loans"
    )


def delinquency_bands(tape: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Loan counts by days past due (an addition: the field is mapped but otherwise unused)."""
    days = strip(F.col("days_past_due").cast("string")).try_cast("double")
    # The band borders.
    band = (
        F.when(days.isNull(), "(blank)").when(days <= 0, "0").when(days <= 30, "1-30")
        .when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise(">90")
    )
    return tape.withColumn("band", band).groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("loans"))


def column_total(df: DataFrame, column: str, keys: Sequence[str] = (), *, compat: bool = False) -> DataFrame:
    """Total of a raw amount column with the number of cells read and skipped."""
    parsed = df.select(*keys, parse_amount(F.col(f"`{column}`"), compat=compat).alias("v"))
    aggs = [
        total(F.col("v")).alias("total"),
        F.count("v").alias("parsed"),
        F.count_if(F.col("v").isNull()).alias("skipped"),
    ]
    return parsed.groupBy(*keys).agg(*aggs) if keys else parsed.agg(*aggs)


def totals_check(reported: DataFrame, independent: DataFrame, reported_column: str, independent_column: str,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Do two columns add up to the same, within a tenth of a percent?

    Both sides are tagged and totalled in one aggregation, so no join is needed.
    """

    def side(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("side"), parse_amount(F.col(f"`{column}`")).alias("v"))

    both = side(reported, reported_column, "r").unionByName(side(independent, independent_column, "i"))
    r, i = F.col("side") == "r", F.col("side") == "i"
    summed = (both.groupBy(*keys) if keys else both.groupBy()).agg(
        exact_sum(F.col("v"), r).alias("_r"), exact_sum(F.col("v"), i).alias("_i"),
        F.count_if(r & F.col("v").isNotNull()).alias("reported_parsed"),
        F.count_if(r & F.col("v").isNull()).alias("reported_skipped"),
        F.count_if(i & F.col("v").isNotNull()).alias("independent_parsed"),
        F.count_if(i & F.col("v").isNull()).alias("independent_skipped"),
    )
    diff = F.col("_r") - F.col("_i")
    tolerance = F.greatest(F.abs("_r"), F.abs("_i")).cast("double") * 0.001
    return summed.select(
        *keys,
        to_double(F.col("_r")).alias("reported_total"), to_double(F.col("_i")).alias("independent_total"),
        to_double(diff).alias("difference"), (F.abs(diff).cast("double") <= tolerance).alias("totals_match"),
        "reported_parsed", "reported_skipped", "independent_parsed", "independent_skipped",
    )


def coverage(ingested: Column, population: Column) -> Column:
    """Percent of a population covered; an empty population is fully covered."""
    return F.round(F.coalesce(F.try_divide(ingested * F.lit(100.0), population.cast("double")), F.lit(100.0)), 2)


def row_coverage(raw: DataFrame, ingested: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Rows that normalised against the raw rows read."""
    counted = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("population_size")).join(
        ingested.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_ingested")), list(keys), "left"
    )
    n = F.coalesce(F.col("rows_ingested"), F.lit(0))
    return counted.select(*keys, n.alias("rows_ingested"), "population_size",
                          coverage(n, F.col("population_size")).alias("coverage_pct"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Registry lookups found, without data, and failed."""
    s = F.coalesce(F.col(status), F.lit(""))
    return df.agg(
        F.count_if(s == "Found").alias("found"),
        F.count_if(s == "No data").alias("no_data"),
        F.count_if(s.startswith("Error")).alias("errors"),
    )
