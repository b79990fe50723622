"""Statement text -> rows and metadata.

One row per file holds the whole text. Lines are parsed inside that row with
array expressions, so no line is shuffled and files are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import strip
from tallyweave.operators.normalize import canonical
from tallyweave.schema import DIR_IN, DIR_OUT

# Line and metadata formats.
LINE_END = r"\R|[\x1c-\x1e]"
NUMBER = r"(?<![\d.])[-+]?[0-9][0-9,]*\.\d{2}(?![\d.])"
TWO_DATES = r"^(\d{1,2}[-/.]\d{1,2}(?:[-/.]\d{2,4})?)\s+\d{1,2}[-/.]\d{1,2}(?:[-/.]\d{2,4})?\s+(.+)$"
ONE_DATE = r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\s+(.+?)\s+([-+]?[0-9][0-9,]*\.\d{2})"
ISO_LINE = r"^(\d{4}-\d{2}-\d{2})\s+(.+)$"
FULL_DATE_YEAR = r"\b\d{1,2}[-/]\d{1,2}[-/](\d{4})\b"
CODE_TOKEN = r"^[A-Z0-9][A-Z0-9-]{4,}\s+"
BALANCE_SUMMARY = r"(?i)STARTING BALANCE.*ENDING BALANCE"
DEPOSIT_WORDS = ("deposit", "salary", "payroll", "credit", "transfer from", "refund", "interest")
TABLE_WORDS = ("#", "DATE", "NARRATION", "DEBIT", "CREDIT", "BALANCE")
BANKS = (
    "absa", "sterling", "gtbank", "gt bank", "access bank", "equity", "kcb",
    "cooperative bank", "stanbic", "standard chartered", "bbva", "interbank",
    "bancolombia", "baz", "ncba", "mono", "withmono", "safaricom", "mtn",
)
CURRENCY = r"(?i)\b(KES|NGN|USD|PEN|EUR|GBP|UGX|TZS|RWF|ZMW|MXN|COP|BRL|GHS|XOF|ZAR|SOLES|DOLARES)\b"
CURRENCY_ALIASES = {"SOLES": "PEN", "DOLARES": "USD"}
ACCOUNT_NUMBER = r"(?i)account(?: no\.?| number)?[^\d]{0,24}(\d{6,14})"
FIGURE = r"[^\d\n]{0,15}([\d,]+\.\d{2})"
TOTAL_DEBITS = r"(?i)total\s+debits?" + FIGURE
TOTAL_CREDITS = r"(?i)total\s+credits?" + FIGURE
TOTAL_WITHDRAWALS = r"(?i)total\s+withdrawals?\(?-?\)?" + FIGURE
TOTAL_DEPOSITS = r"(?i)total\s+deposits?\(?\+?\)?" + FIGURE
AVAILABLE = r"(?i)available\s+balance" + FIGURE
OPENING = r"(?i)(?:saldo\s+anterior|starting\s+balance|opening\s+balance)" + FIGURE
TOTALS_BLOCK = (
    r"(?i)available\s+balance\s+total\s+debits?\s+total\s+credits?\s*\n"
    r"[^\n]*?([\d,]+\.\d{2})[^\n]*?([\d,]+\.\d{2})[^\n]*?([\d,]+\.\d{2})"
)
PERIOD = (
    r"(?i)(?:statement\s+period|statement\s+date)?[:\s]*([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
    r"\s*(?:to|[-–—])\s*([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
)
OCR_CEILING = 0.6

_FIRST_NUMBER_PREFIX = r"^(.*?)" + NUMBER


def number_of(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def lines(statements: DataFrame) -> DataFrame:
    """``file, line_no, line`` (zero-based), for callers that want lines as rows."""
    return statements.select("file", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))


def _all_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def _summary_numbers(lines_: Column, wanted: int) -> Column:
    """Numbers of the first line with at least ``wanted``, in the two lines after a balance-summary header."""
    at = F.filter(F.sequence(F.lit(1), F.size(lines_)), lambda i: F.element_at(lines_, i).rlike(BALANCE_SUMMARY))
    after = F.flatten(F.transform(at, lambda i: F.slice(lines_, i + 1, 2)))
    hits = F.filter(F.transform(after, _all_numbers), lambda n: F.size(n) >= wanted)
    return F.get(hits, F.lit(0))


def _flat_rows(lines_: Column, year: Column) -> Column:
    """Rows of the two-date layout, else of the single-date layout, per line."""

    def with_parts(line: Column, i: Column) -> Column:
        t = strip(line)
        rest = F.regexp_extract(t, TWO_DATES, 2)
        return F.struct(
            i.alias("line_no"), line.alias("line"), F.regexp_extract(t, TWO_DATES, 1).alias("d1"),
            rest.alias("rest"), _all_numbers(rest).alias("nums"),
        )

    def parsed(p: Column) -> Column:
        nums, d1 = p["nums"], p["d1"]
        dated = F.when(
            (F.length(F.regexp_replace(d1, r"[^-/.]", "")) == 1) & (year != ""), F.concat(d1, F.lit("-"), year)
        ).otherwise(d1)
        first = number_of(F.get(nums, F.lit(0)))
        two = F.struct(
            p["line_no"].alias("line_no"), dated.alias("value_date"), first.alias("signed"),
            F.trim(F.regexp_extract(p["rest"], _FIRST_NUMBER_PREFIX, 1)).alias("description"),
            number_of(F.element_at(nums, -1)).alias("balance"),
        )
        amount = F.regexp_extract(p["line"], ONE_DATE, 3)
        one = F.struct(
            p["line_no"].alias("line_no"), F.regexp_extract(p["line"], ONE_DATE, 1).alias("value_date"),
            number_of(amount).alias("signed"), F.trim(F.regexp_extract(p["line"], ONE_DATE, 2)).alias("description"),
            F.lit(None).cast("double").alias("balance"),
        )
        return F.when(F.size(nums) >= 2, two).when(p["line"].rlike(ONE_DATE), one)

    return F.filter(F.transform(F.transform(lines_, with_parts), parsed), lambda r: r.isNotNull())


def _running_rows(lines_: Column) -> Column:
    """Rows of the ISO running-balance layout, sign still open."""

    def with_parts(line: Column, i: Column) -> Column:
        t = strip(line)
        rest = F.regexp_extract(t, ISO_LINE, 2)
        return F.struct(i.alias("line_no"), F.regexp_extract(t, ISO_LINE, 1).alias("d"), rest.alias("rest"), _all_numbers(rest).alias("nums"))

    def parsed(p: Column) -> Column:
        text = F.trim(F.regexp_extract(p["rest"], _FIRST_NUMBER_PREFIX, 1))
        text = F.trim(F.regexp_replace(F.regexp_replace(text, CODE_TOKEN, ""), r"[\s$]+$", ""))
        return F.struct(
            p["line_no"].alias("line_no"), p["d"].alias("value_date"), F.abs(number_of(F.get(p["nums"], F.lit(0)))).alias("amount"),
            text.alias("description"), number_of(F.element_at(p["nums"], -1)).alias("balance"),
        )

    kept = F.filter(F.transform(lines_, with_parts), lambda p: F.size(p["nums"]) >= 2)
    return F.transform(kept, parsed)


def deposit_worded(description: Column) -> Column:
    hit = F.lit(False)
    for word in DEPOSIT_WORDS:
        hit = hit | F.lower(description).contains(word)
    return hit


def balance_direction(amount: Column, balance: Column, before: Column, description: Column) -> Column:
    """Direction from the step of a running balance; without an earlier one, from the wording."""
    return (
        F.when(before.isNull(), F.when(deposit_worded(description), DIR_IN).otherwise(DIR_OUT))
        .when(F.round(before + amount, 2) == F.round(balance, 2), DIR_IN)
        .when(F.round(before - amount, 2) == F.round(balance, 2), DIR_OUT)
        .when(balance > before, DIR_IN).otherwise(DIR_OUT)
    )


def parse(statements: DataFrame) -> DataFrame:
    """``file, text`` -> canonical rows plus ``balance``, ``layout_used`` and ``line_no``.

    The flat layouts are tried line by line; only a file without any such row is
    read as ISO running balance.
    """
    keep = [c for c in ("file", "borrower", "ocr") if c in statements.columns]
    base = statements.select(
        *keep, split_lines(F.col("text")).alias("ls"), F.regexp_extract("text", FULL_DATE_YEAR, 1).alias("year")
    )
    flat = base.withColumn("flat", _flat_rows(F.col("ls"), F.col("year")))
    iso = flat.withColumn("iso", F.when(F.size("flat") == 0, _running_rows(F.col("ls")))).withColumn(
        "start", F.when(F.size("flat") == 0, number_of(F.get(_summary_numbers(F.col("ls"), 1), F.lit(0))))
    )
    signed = F.transform(
        F.col("iso"),
        lambda r, i: F.struct(
            r["line_no"].alias("line_no"), r["value_date"].alias("value_date"), r["amount"].alias("amount"),
            balance_direction(
                r["amount"], r["balance"],
                F.when(i == 0, F.col("start")).otherwise(F.get(F.col("iso"), i - 1)["balance"]), r["description"],
            ).alias("direction"),
            r["description"].alias("description"), r["balance"].alias("balance"), i.alias("n"),
        ),
    )
    plain = F.transform(
        F.col("flat"),
        lambda r: F.struct(
            r["line_no"].alias("line_no"), r["value_date"].alias("value_date"), F.abs(r["signed"]).alias("amount"),
            F.when(r["signed"] >= 0, F.lit(DIR_IN)).otherwise(F.lit(DIR_OUT)).alias("direction"),
            r["description"].alias("description"), r["balance"].alias("balance"), r["line_no"].alias("n"),
        ),
    )
    rows = iso.select(
        *keep, F.when(F.size("flat") > 0, F.lit("flat")).otherwise(F.lit("iso_running")).alias("layout_used"),
        F.explode(F.when(F.size("flat") > 0, plain).otherwise(signed)).alias("r"),
    )
    out = rows.select(
        *keep, "layout_used", "r.*", F.col("file").alias("account_ref"),
        F.concat(F.lit("bank:"), F.col("file"), F.lit(":"), F.col("r.n").cast("string")).alias("key"),
        F.lit("bank").alias("sheet"), F.lit("bank").alias("source_type"), F.lit("").alias("currency"),
        F.lit(1.0).alias("confidence"), F.col("r.line_no").cast("long").alias("seq"),
    )
    if "borrower" not in keep:
        out = out.withColumn("borrower", F.lit(None).cast("string"))
    return out.drop("n")


def closing_balances(rows: DataFrame) -> DataFrame:
    """Balance after the last row of each file; null for layouts without a balance."""
    last = F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("line_no")))
    return rows.groupBy("file").agg(last.alias("closing_balance"))


def running_direction(rows: DataFrame, starts: DataFrame | None = None, keys: tuple[str, ...] = ("file",), order: str = "line_no") -> DataFrame:
    """Direction of rows that carry only an amount and a running balance."""
    from tallyweave.operators.ordered import previous_value

    prev = previous_value(rows, keys, [F.col(order)], "balance", "_before")
    if starts is not None:
        prev = prev.join(starts.select(*keys, "start"), list(keys), "left")
        before = F.coalesce(F.col("_before"), F.col("start"))
    else:
        before = F.col("_before")
    out = prev.withColumn("direction", balance_direction(F.col("amount"), F.col("balance"), before, F.col("description")))
    return out.drop("_before", "start")


def shape(statements: DataFrame) -> DataFrame:
    """One row of declared metadata per file: layout, bank, account, currency, period, totals, balances."""
    t = F.col("text")
    has_table = F.lit(True)
    for word in TABLE_WORDS:
        has_table = has_table & t.contains(word)
    layout = (
        F.when(has_table, "numbered_table")
        .when(t.rlike(BALANCE_SUMMARY) & t.rlike(r"(?m)^\d{4}-\d{2}-\d{2}[^\S\n]+.+$"), "iso_running")
        .when(t.rlike(r"(?m)^\d{1,2}[-/.]\d{1,2}(?:[-/.]\d{2,4})?[^\S\n]+\d{1,2}[-/.]\d{1,2}(?:[-/.]\d{2,4})?[^\S\n]+.+$"), "two_date")
        .when(t.rlike(ONE_DATE), "single_date").otherwise("")
    )
    lower = F.lower(t)
    bank = F.coalesce(*[F.when(lower.contains(b), F.lit(b)) for b in BANKS], F.lit(""))
    code = F.upper(F.regexp_extract(t, CURRENCY, 1))
    for alias, iso in CURRENCY_ALIASES.items():
        code = F.when(code == alias, F.lit(iso)).otherwise(code)
    block = t.rlike(TOTALS_BLOCK)

    def money(pattern: str, group: int = 1) -> Column:
        return number_of(F.nullif(F.regexp_extract(t, pattern, group), F.lit("")))

    base = statements.withColumn("_ls", split_lines(t))
    closing = number_of(F.get(_summary_numbers(F.col("_ls"), 4), F.lit(3)))
    starting = number_of(F.get(_summary_numbers(F.col("_ls"), 1), F.lit(0)))
    keep = [c for c in ("file", "borrower", "ocr") if c in statements.columns]
    return base.select(
        *keep, F.col("file").alias("account_ref"), layout.alias("layout"), bank.alias("bank"),
        F.regexp_extract(t, ACCOUNT_NUMBER, 1).alias("account_no"), code.alias("currency"),
        F.regexp_extract(t, PERIOD, 1).alias("period_start"), F.regexp_extract(t, PERIOD, 2).alias("period_end"),
        F.when(block, money(TOTALS_BLOCK, 1)).otherwise(money(AVAILABLE)).alias("available_balance"),
        F.when(block, money(TOTALS_BLOCK, 2)).otherwise(F.coalesce(money(TOTAL_DEBITS), money(TOTAL_WITHDRAWALS))).alias("total_debits"),
        F.when(block, money(TOTALS_BLOCK, 3)).otherwise(F.coalesce(money(TOTAL_CREDITS), money(TOTAL_DEPOSITS))).alias("total_credits"),
        F.when(layout == "iso_running", starting).otherwise(money(OPENING)).alias("opening_balance"),
        closing.alias("closing_balance"),
    )


def tie_out(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Do a file's rows add up to what it declares? True, false, or null when it declares nothing."""
    from tallyweave.functions.money import total

    sums = rows.groupBy("file").agg(
        total(F.col("amount"), F.col("direction") == DIR_OUT).alias("debits"),
        total(F.col("amount"), F.col("direction") == DIR_IN).alias("credits"),
    )

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= F.greatest(F.lit(0.01), F.abs(b) * 0.005)

    d, c, o, e = (F.col(x) for x in ("total_debits", "total_credits", "opening_balance", "closing_balance"))
    declared = F.coalesce(close(F.col("debits"), d), F.lit(True)) & F.coalesce(close(F.col("credits"), c), F.lit(True))
    verdict = F.when(d.isNotNull() | c.isNotNull(), declared).when(
        o.isNotNull() & e.isNotNull(), close(o + F.col("credits") - F.col("debits"), e)
    )
    return shapes.join(sums, "file").withColumn("tied_out", verdict)


def grade(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Confidence from the tie-out where the layout supports one; scanned rows are capped.

    The tie-out decides for the numbered table and the ISO running balance only.
    """
    checked = tie_out(rows, shapes).select(
        "file", F.when(F.col("layout").isin("numbered_table", "iso_running"), F.col("tied_out")).alias("_t")
    )
    out = rows.join(checked, "file", "left")
    out = out.withColumn("tie_out", F.when(F.col("_t"), "ok").when(~F.col("_t"), "failed"))
    base = F.when(F.col("_t").isNull(), F.col("confidence")).when(F.col("_t"), 1.0).otherwise(0.5)
    if "ocr" in rows.columns:
        base = F.when(F.coalesce(F.col("ocr"), F.lit(False)), F.least(base, F.lit(OCR_CEILING))).otherwise(base)
    return out.withColumn("confidence", base).drop("_t")


def placeholders(statements: DataFrame, rows: DataFrame, reason: str) -> DataFrame:
    """A zero-confidence row for every file that gave none, so it is not silently absent."""
    missing = statements.join(rows.select("file").distinct(), "file", "left_anti")
    borrower = F.col("borrower") if "borrower" in statements.columns else F.lit(None).cast("string")
    return canonical(
        missing.select(
            borrower.alias("borrower"), F.concat(F.lit("bank:"), F.col("file"), F.lit(":unmapped")).alias("key"),
            F.lit("bank").alias("sheet"), F.lit("bank").alias("source_type"), F.lit("").alias("value_date"),
            F.lit(0.0).alias("amount"), F.lit("").alias("direction"), F.lit("").alias("currency"),
            F.lit(reason).alias("description"), F.col("file").alias("account_ref"), F.lit(0.0).alias("confidence"),
            F.lit(0).cast("long").alias("seq"),
        )
    )


def ingest(statements: DataFrame) -> DataFrame:
    """Whole path: parse, stamp the declared currency, grade, and stand in for files without a row."""
    from tallyweave.operators.normalize import stamp_currency

    rows, shapes = parse(statements), shape(statements)
    graded = stamp_currency(grade(rows, shapes), shapes)
    reason = "text layer present but no line matched a known layout; manual spot-check required"
    return canonical(graded).unionByName(placeholders(statements, rows, reason))
