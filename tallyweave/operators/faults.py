"""What keeps a tape from being verified, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyweave.functions.dates import parse_when
from tallyweave.functions.money import plain_number
from tallyweave.functions.text import blank_to_null

MONEY = ("principal_amount", "total_loan_amount", "principal_outstanding", "interest_outstanding", "fee_outstanding", "penalty_outstanding")
DATES = ("begin_date", "closure_date", "company_due_date")
REQUIRED = ("loan_id",)


def cell_faults(tape: DataFrame, *, required: Sequence[str] = REQUIRED, money: Sequence[str] = MONEY, dates: Sequence[str] = DATES) -> DataFrame:
    """``borrower, field, reason, value`` for every cell that cannot be used.

    A required cell is blank, a money cell holds no number, a date cell no date.
    Blank money and dates are no faults. Columns that a tape does not have are
    passed over, except required ones, which are blank in every row. Nothing is
    thrown: each cell is tried, and all rows are judged in one pass.
    """
    types = {f.name: f.dataType for f in tape.schema}
    text = lambda c: blank_to_null(F.col(f"`{c}`").cast("string"))

    def fault(field: str, bad: Column, reason: str, value: Column) -> Column:
        return F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), value.cast("string").alias("value")))

    checks = []
    for c in required:
        missing = text(c).isNull() if c in types else F.lit(True)
        checks.append(fault(c, missing, "missing", F.lit(None)))
    for c in (c for c in money if c in types and not isinstance(types[c], T.NumericType)):
        # Parsing counts what is no number as 0; here it is told.
        checks.append(fault(c, text(c).isNotNull() & plain_number(F.replace(text(c), F.lit(","), F.lit(""))).isNull(), "not an amount", text(c)))
    for c in (c for c in dates if c in types and isinstance(types[c], T.StringType)):
        checks.append(fault(c, text(c).isNotNull() & parse_when(F.col(f"`{c}`")).isNull(), "not a date", text(c)))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return tape.select("borrower", F.explode(found).alias("f")).select("borrower", "f.*")


def tape_faults(tape: DataFrame, **columns: Sequence[str]) -> DataFrame:
    """``borrower, error``: one line per borrower with faults, telling how many there are and the first one by field, reason and value."""
    first = F.min(F.struct("field", "reason", F.coalesce("value", F.lit("")).alias("value"))).alias("f")
    found = cell_faults(tape, **columns).groupBy("borrower").agg(F.count(F.lit(1)).alias("n"), first)
    where = F.when(F.col("f.value") == "", "").otherwise(F.concat(F.lit(" '"), F.col("f.value"), F.lit("'")))
    return found.select("borrower", F.concat(F.col("n").cast("string"), F.lit(" unusable cells, first: "), F.col("f.field"), F.lit(" "), F.col("f.reason"), where).alias("error"))
