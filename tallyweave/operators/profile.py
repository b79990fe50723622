"""Schema audit, population profile and sanity checks of tapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyweave.config import TAPE_EXPECTED_MONEY, TapeColumns
from tallyweave.functions.text import blank_to_null


def schema_audit(
    columns: DataFrame, config: TapeColumns | None = None, expected: Sequence[str] = TAPE_EXPECTED_MONEY,
) -> DataFrame:
    """``borrower, field, column, present``: which expected fields each borrower's table has.

    ``columns`` (borrower, column) lists the tables' columns, for any number of
    borrowers. Only the configured names, a constant, come from the driver.
    """
    config, spark = config or TapeColumns(), columns.sparkSession
    usual = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(config.resolve().get(f, f)).alias("_usual")) for f in expected])
    own = spark.createDataFrame(
        [(b, f, c) for b, names in config.overrides.items() for f, c in names.items() if f in expected], "borrower string, field string, _own string"
    )
    asked = columns.select("borrower").distinct().select("borrower", F.inline(usual)).join(own, ["borrower", "field"], "left")
    asked = asked.select("borrower", "field", F.coalesce("_own", "_usual").alias("column"))
    have = columns.select("borrower", "column").distinct().withColumn("_have", F.lit(True))
    return asked.join(have, ["borrower", "column"], "left").select("borrower", "field", "column", F.coalesce("_have", F.lit(False)).alias("present"))


def population(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Non-blank count and share per field, one scan."""
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(blank_to_null(F.col(f"`{f}`"))).alias(f"_f_{f}") for f in fields]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_f_{f}").alias("populated")) for f in fields])
    long = counted.select(*keys, "rows", F.inline(pairs))
    return long.withColumn("populated_pct", F.round(F.try_divide(F.col("populated") * 100.0, F.col("rows")), 2))


def sanity(summary: DataFrame, cohorts: DataFrame, borrowers: DataFrame | None = None) -> DataFrame:
    """Findings on summary figures: negative totals, outstanding beyond half again the loans, cohorts
    that do not add up, and empty tapes (borrowers listed but without rows)."""
    # Grouped on the cohort name only to add: one row per (borrower, cohort).
    sums = cohorts.groupBy("borrower", "cohort").agg(F.sum("loans").alias("n")).groupBy("borrower").agg(
        F.min("n").alias("_min"), F.max("n").alias("_max")
    )
    base = summary if borrowers is None else borrowers.select("borrower").distinct().join(summary, "borrower", "left")
    j = base.join(sums, "borrower", "left")
    money = [c for c in summary.columns if c not in ("borrower", "loan_count")]
    negative = F.lit(False)
    for c in money:
        negative = negative | (F.coalesce(F.col(c), F.lit(0.0)) < 0)
    empty = F.coalesce(F.col("loan_count"), F.lit(0)) == 0
    checks = F.array(
        F.when(empty, F.lit("empty_tape")),
        F.when(negative, F.lit("negative_total")),
        F.when(F.col("total_outstanding") > F.col("total_loan_amount") * 1.5, F.lit("outstanding_exceeds_loans")),
        F.when(~empty & ((F.col("_min") != F.col("loan_count")) | (F.col("_max") != F.col("loan_count"))), F.lit("cohorts_do_not_add_up")),
    )
    return j.select("borrower", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("finding"))
