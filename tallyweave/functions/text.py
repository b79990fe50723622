"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# trim() alone would leave tabs and line ends.
_EDGE_SPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGE_SPACE))


def clean(c: Column) -> Column:
    """Null, NaN text and blanks become '', anything else is trimmed."""
    s = strip(c.cast("string"))
    return F.when(c.isNull() | (s == "NaN"), F.lit("")).otherwise(s)


def blank_to_null(c: Column) -> Column:
    """Absent in any of its spellings: null, '', 'nan'."""
    s = c.cast("string")
    return F.when(strip(s).isin("", "nan", "NaN"), F.lit(None)).otherwise(s)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def normalize_value(
    c: Column,
    *,
    case_sensitive: bool = False,
    ignore_spaces: bool = False,
    ignore_special_chars: bool = False,
) -> Column:
    """Matching key under the caller's chosen leniency; null becomes ''."""
    out = strip(F.coalesce(c.cast("string"), F.lit("")))
    if not case_sensitive:
        out = F.lower(out)
    if ignore_spaces:
        out = F.replace(out, F.lit(" "), F.lit(""))
    if ignore_special_chars:
        out = F.regexp_replace(out, r"(?U)[^\w\s-]", "")
    return out


def name_key(c: Column) -> Column:
    """Case- and space-insensitive name."""
    return F.regexp_replace(strip(F.lower(c)), r"\s+", " ")


def alnum_key(c: Column) -> Column:
    """Lower-cased letters and digits of any script."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def ascii_alnum_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]", ""))


def clean_plate(c: Column) -> Column:
    """Upper-cased letters and digits of a number plate."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def fix_scan_text(c: Column) -> Column:
    """Undo common misreads of scanned text."""
    # At sign -> 0, em and en dash -> hyphen, euro sign -> e.
    return F.translate(c, "@—–€", "0--e")


def strip_html(c: Column) -> Column:
    """Drop script and style blocks, turn every tag into a line end."""
    no_blocks = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    return F.regexp_replace(no_blocks, r"<[^>]+>", "\n")


def thousands(c: Column, digits: int) -> Column:
    """1234.5 -> '1,234.50'."""
    return F.format_number(c, digits)


def fixed(c: Column, digits: int) -> Column:
    """1234.5 -> '1234.50'."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def percent(c: Column, digits: int) -> Column:
    """0.125 -> '12.5%'; an infinite ratio prints as 'inf%'."""
    inf = F.lit(float("inf"))
    return F.when(c == inf, F.lit("inf%")).otherwise(
        F.concat(fixed(F.when(c == inf, F.lit(0.0)).otherwise(c) * 100, digits), F.lit("%"))
    )


def duration_text(seconds: Column) -> Column:
    """Seconds as '1d 2h 3m 5s', zero parts other than seconds left out."""
    total = F.floor(seconds).cast("long")
    days = F.floor(total / 86400).cast("long")
    hours = F.floor(F.pmod(total, F.lit(86400)) / 3600).cast("long")
    minutes = F.floor(F.pmod(total, F.lit(3600)) / 60).cast("long")
    secs = F.pmod(total, F.lit(60))

    def part(n: Column, unit: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(unit)))

    text = F.concat_ws(
        " ", part(days, "d"), part(hours, "h"), part(minutes, "m"), F.concat(secs.cast("string"), F.lit("s"))
    )
    return F.when(seconds.isNull(), F.lit("not signed off")).otherwise(text)


def exception_pattern(exception_id: Column, kind: Column) -> Column:
    """Rule tag inside an exception id, else the kind."""
    tag = F.regexp_extract(exception_id, r"(?:^|:)(?:recon|anom|asset|match):([^:]+)", 1)
    return F.coalesce(F.nullif(tag, F.lit("")), kind)


def run_of_event(run_id: Column, exception_id: Column) -> Column:
    """The run an event belongs to: its own id or the prefix of its exception id."""
    return F.coalesce(
        F.nullif(run_id, F.lit("")),
        F.when(exception_id.contains(":"), F.substring_index(exception_id, ":", 1)),
    )


def containment_verdict(expected: Column, brand: Column, model: Column) -> Column:
    """Compare a free-text vehicle with the registry's brand and model."""
    b, m = F.coalesce(brand, F.lit("")), F.coalesce(model, F.lit(""))
    kb, km, e = alnum_key(b), alnum_key(m), alnum_key(F.coalesce(expected, F.lit("")))
    whole = F.concat(kb, km)
    return (
        F.when((b == "") | (m == ""), "No data")
        .when(e == "", F.when(whole != "", "Mismatch").otherwise("No data"))
        .when(F.contains(whole, e) | F.contains(e, whole), "Match")
        .when(((kb != "") & F.contains(e, kb)) | ((km != "") & F.contains(e, km)), "Partial Match")
        .otherwise("Mismatch")
    )


def lookup_status(status: Column, brand: Column, owner: Column, error: Column | None = None) -> Column:
    """Registry lookup outcome."""
    found = F.coalesce(
        F.nullif(status, F.lit("")),
        F.when((F.coalesce(brand, F.lit("")) != "") | (F.coalesce(owner, F.lit("")) != ""), F.lit("Found")).otherwise(
            F.lit("No data")
        ),
    )
    if error is None:
        return found
    return F.when(error.isNotNull(), F.concat(F.lit("Error: "), F.substring(error, 1, 60))).otherwise(found)
