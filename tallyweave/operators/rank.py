"""Ranking, routing and top lists of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.config import Thresholds
from tallyweave.functions.text import exception_pattern, fixed
from tallyweave.session import pin

# Rules that signal intent and are always referred.
INTENT_RULES = ("roundtrip", "microsplit", "seqjump")


def rank(exceptions: DataFrame, scope: tuple[str, ...] = ("borrower",)) -> DataFrame:
    """Severity scaled to 0..1 within the run; a lone or uniform severity becomes 0. The raw one is kept."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("severity")))
    clamped = exceptions.withColumn("severity_raw", raw)
    span = pin(clamped.groupBy(*scope).agg(F.min("severity_raw").alias("_lo"), F.max("severity_raw").alias("_hi")))
    scaled = F.round(
        F.coalesce(F.try_divide(F.col("severity_raw") - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0.0)), 4
    )
    return (
        clamped.join(span, list(scope))
        .withColumn("severity", scaled)
        .withColumn("description", F.concat(F.col("description"), F.lit(" [severity="), fixed(F.col("severity"), 2), F.lit("]")))
        .drop("_lo", "_hi")
    )


def ordered(exceptions: DataFrame) -> DataFrame:
    """Most severe first; ties by id, so the order never depends on partitioning."""
    return exceptions.orderBy(F.desc("severity"), "id")


def forensic(exceptions: DataFrame, limits: Thresholds) -> DataFrame:
    return exceptions.filter(F.col("severity") >= limits.anomaly_score_high)


def is_referral(rule: Column) -> Column:
    """By rule, not by severity: scaling can push a serious finding down."""
    return rule.isin(*INTENT_RULES)


def referrals(exceptions: DataFrame) -> DataFrame:
    return exceptions.filter(is_referral(F.col("rule")))


def top(exceptions: DataFrame, n: int = 25) -> DataFrame:
    """The n most severe, with the full count and whether the list is cut."""
    total = exceptions.agg(F.count(F.lit(1)).alias("total"))
    shown = exceptions.orderBy(F.desc("severity"), "id").limit(n)
    # A one-row scalar, not a join.
    return shown.withColumn("exception_count_total", total.scalar()).withColumn(
        "exceptions_truncated", F.col("exception_count_total") > n
    )


def top_for_report(exceptions: DataFrame, n: int = 20) -> DataFrame:
    return exceptions.orderBy(F.desc("severity"), F.desc("id")).limit(n)


def by_kind(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("kind").agg(F.count(F.lit(1)).alias("exceptions")).orderBy(F.desc("exceptions"), "kind")


def by_pattern(exceptions: DataFrame) -> DataFrame:
    pattern = exception_pattern(F.col("id"), F.col("kind"))
    return exceptions.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("exceptions"))
