"""Date expressions. ``value_date`` is text in any of several formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month-name prefixes in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_key(c: Column) -> Column:
    """yyyy-MM of an ISO or dd-MM-yyyy prefix, else '(undated)'."""
    s = F.trim(F.coalesce(c, F.lit("")))
    iso, dmy = r"^(\d{4})-(\d{2})-\d{2}", r"^(\d{2})-(\d{2})-(\d{4})"
    return (
        F.when(s.rlike(iso), F.substring(s, 1, 7))
        .when(s.rlike(dmy), F.concat(F.regexp_extract(s, dmy, 3), F.lit("-"), F.regexp_extract(s, dmy, 2)))
        .otherwise(F.lit("(undated)"))
    )


def parse_when(c: Column) -> Column:
    """Timestamp of an ISO date or date-time, or of a day-first numeric date; else null."""
    s = F.trim(c)
    day_first = F.regexp_replace(s, r"[/.]", "-")
    iso_like = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    return F.when(iso_like, s.try_cast("timestamp")).otherwise(
        F.coalesce(
            F.try_to_timestamp(F.when(day_first.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), day_first), F.lit("d-M-yyyy")),
            F.try_to_timestamp(F.when(day_first.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), day_first), F.lit("d-M-yy")),
        )
    )


def hour_of(c: Column) -> Column:
    """Hour carried by a date text, null when it has no time part."""
    hit = F.regexp_extract(F.coalesce(c, F.lit("")), r"[T ](\d{1,2}):\d{2}", 1)
    hour = F.when(hit != "", hit.cast("int"))
    return F.when(hour.between(0, 23), hour)


def month_name_date(c: Column) -> Column:
    """'June 23rd 2022' -> '2022-06-23', else ''."""
    pattern = r"\b([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?[\s,]+(\d{4})\b"
    months = F.array(*[F.lit(m) for m in MONTHS])
    name = F.lower(F.substring(F.regexp_extract(c, pattern, 1), 1, 3))
    number = F.array_position(months, name)
    return F.when(
        number > 0,
        F.concat_ws(
            "-",
            F.regexp_extract(c, pattern, 3),
            F.lpad(number.cast("string"), 2, "0"),
            F.lpad(F.regexp_extract(c, pattern, 2), 2, "0"),
        ),
    ).otherwise(F.lit(""))
