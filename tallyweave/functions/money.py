"""Money expressions.

Amounts stay DOUBLE at the edges. Sums are taken over DECIMAL(28,10), so a total
does not depend on how rows were partitioned, and come back as DOUBLE rounded to
four decimals in the decimal domain.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave.functions.text import strip

EXACT = "decimal(28,10)"
_NUMBER_CHARS = "0123456789+-.eE"


def exact(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast(EXACT)


def exact_sum(c: Column, where: Column | None = None) -> Column:
    value = exact(c)
    if where is not None:
        value = F.when(where, value).otherwise(F.lit(0).cast(EXACT))
    return F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,10)"))


def to_double(total: Column) -> Column:
    return total.cast("decimal(38,4)").cast("double")


def total(c: Column, where: Column | None = None) -> Column:
    return to_double(exact_sum(c, where))


def plain_number(c: Column) -> Column:
    """Text of a plain decimal number as DOUBLE, else null."""
    s = strip(c.cast("string"))
    # A cast alone would also take suffixes and words such as 1.0d or Infinity.
    return F.when(F.translate(s, _NUMBER_CHARS, "") == "", s.try_cast("double"))


def parse_money(c: Column, numeric: bool = False) -> Column:
    """Tape money: commas removed; blank, NaN or garbage counts as 0. A numeric column skips the text work."""
    if numeric:
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(plain_number(F.replace(c.cast("string"), F.lit(","), F.lit(""))), F.lit(0.0))


def parse_amount(c: Column, *, compat: bool = False) -> Column:
    """Tolerant amount: currency marks dropped, parentheses negative, else null.

    A minus sign after a currency code ("KES -500") is honoured; ``compat=True``
    reads only a leading one.
    """
    s = strip(c.cast("string"))
    wrapped = s.rlike(r"(?s)^\(.*\)$")
    minus = s.startswith("-") if compat else s.rlike(r"^[^0-9]*-[^0-9]*[0-9.]")
    digits = F.regexp_replace(F.regexp_replace(s, r"[^0-9.\-]", ""), r"^-+", "")
    value = F.when(digits.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), digits.try_cast("double"))
    return F.when(wrapped | minus, -value).otherwise(value)
