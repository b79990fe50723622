"""Rules that judge one row: round amounts, volume, pattern breaks, off-hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.config import Thresholds
from tallyweave.functions.dates import hour_of, parse_when
from tallyweave.functions.text import fixed, thousands
from tallyweave.operators.ordered import HOT_ROWS, exclusive_prefix
from tallyweave.operators.rules.base import Findings, Prepared, single_row


def _quoted() -> Column:
    return F.concat(F.lit("('"), F.col("description"), F.lit("')"))


def roundness(amount: Column) -> Column:
    """1 for whole thousands, a half for whole hundreds, else 0."""
    return (
        F.when(amount <= 0, 0.0).when(F.pmod(amount, F.lit(1000.0)) == 0, 1.0)
        .when(F.pmod(amount, F.lit(100.0)) == 0, 0.5).otherwise(0.0)
    )


def round_amounts(p: Prepared, limits: Thresholds) -> Findings:
    """Round amounts that are also large for this portfolio."""
    amt, med, r = F.col("amt"), F.col("median_amt"), roundness(F.col("amt"))
    hits = p.with_median().filter((r > 0) & (med > 0) & (amt > med * limits.round_dollar_materiality_multiple))
    size = F.least(F.lit(1.0), amt / (med * limits.transaction_volume_multiple))
    severity = F.round(F.least(F.lit(1.0), 0.2 + 0.4 * r + 0.2 * size), 4)
    text = F.concat(
        F.lit("Round-dollar amount "), thousands(amt, 2), F.lit(" is "), fixed(amt / med, 1),
        F.lit("x the median "), thousands(med, 2), F.lit(" "), _quoted(),
    )
    return single_row(hits, "round", severity, text)


def volume(p: Prepared, limits: Thresholds) -> Findings:
    """Amounts many times the portfolio median."""
    amt, med, k = F.col("amt"), F.col("median_amt"), limits.transaction_volume_multiple
    hits = p.with_median().filter((med > 0) & (amt > med * k))
    text = F.concat(
        F.lit("Volume anomaly: "), thousands(amt, 2), F.lit(f" > {k:,.0f}x median "), thousands(med, 2),
        F.lit(" "), _quoted(),
    )
    return single_row(hits, "vol", F.lit(0.6), text)


def off_hours(p: Prepared, limits: Thresholds) -> Findings:
    """Rows timed outside business hours. A sheet timed only at midnight carries bare dates."""
    hour = hour_of(F.col("value_date"))
    timed = p.rows.withColumn("hour", hour).filter(F.col("hour").isNotNull())
    at_midnight = F.col("value_date").rlike(r"[T ]0?0:00(:00)?(\.0+)?$")
    real = timed.groupBy("borrower", "sheet", "account_ref").agg(F.count_if(~at_midnight).alias("_timed"))
    odd = timed.filter((F.col("hour") >= limits.off_hours_start_hour) | (F.col("hour") < limits.off_hours_end_hour))
    hits = odd.join(real.filter(F.col("_timed") > 0), ["borrower", "sheet", "account_ref"], "left_semi")
    text = F.concat(
        F.lit("Off-hours transaction at "), F.lpad(F.col("hour").cast("string"), 2, "0"),
        F.lit(f":00 (outside {limits.off_hours_start_hour:02d}:00-{limits.off_hours_end_hour:02d}:00 business window): "),
        thousands(F.col("amt"), 2), F.lit(" "), _quoted(),
    )
    return single_row(hits, "offhours", F.lit(0.5), text)


def trailing_mean(rows: DataFrame, *, compat: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add how many rows of the account came earlier and the sum of their amounts.

    Rows are ordered by time, then by date text and input order; ``compat``
    orders by date text alone, as text.
    """
    dated = rows.withColumn("_when", F.lit(None).cast("timestamp") if compat else parse_when(F.col("value_date")))
    order = [F.col("_when").asc_nulls_first(), F.coalesce(F.col("value_date"), F.lit("")), F.col("seq"), F.col("key")]
    dated = dated.filter(F.col("account_ref") != "")
    return exclusive_prefix(dated, ["borrower", "sheet", "account_ref"], order, ["amt"], hot_rows=hot_rows)


def pattern_breaks(p: Prepared, limits: Thresholds, *, compat: bool = False, hot_rows: int = HOT_ROWS) -> Findings:
    """Amounts far above the account's own mean so far."""
    n, amt = F.col("rows_before"), F.col("amt")
    placed = trailing_mean(p.rows, compat=compat, hot_rows=hot_rows)
    enough = placed.filter((n >= limits.sequence_jump_min_window) & (n > 0))
    judged = enough.withColumn("mean", F.col("amt_before").cast("double") / n)
    hits = judged.filter((F.col("mean") > 0) & (amt > F.col("mean") * limits.sequence_jump_multiple))
    text = F.concat(
        F.lit("Pattern break on account '"), F.col("account_ref"), F.lit("': "), thousands(amt, 2), F.lit(" is "),
        fixed(amt / F.col("mean"), 1), F.lit("x its own trailing average "), thousands(F.col("mean"), 2),
        F.lit(" (last "), n.cast("string"), F.lit(" txns) "), _quoted(),
    )
    return single_row(hits, "seqjump", F.lit(0.75), text)
