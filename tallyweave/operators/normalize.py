"""Raw rows -> canonical transaction rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyweave.config import TAPE_KEY_FIELDS, CategoryRule, TapeColumns
from tallyweave.functions.dates import month_key, parse_when
from tallyweave.functions.money import parse_money, plain_number
from tallyweave.functions.text import ascii_alnum_key, blank_to_null, clean, first_present
from tallyweave.schema import DIR_IN, DIR_OUT, TRANSACTION

# Keywords per statement role, in order of preference.
ROLE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "date": ("date",),
    "description": ("description", "narration", "particular", "memo", "details"),
    "amount": ("amount", "value", "amt"),
    "debit": ("debit", "withdrawal", " dr", "(-)"),
    "credit": ("credit", "deposit", " cr", "(+)"),
    "balance": ("balance",),
}

# Canonical field -> column names tried in order, for simple tables.
SIMPLE_FIELDS: dict[str, tuple[str, ...]] = {
    "value_date": ("value_date", "date"),
    "amount": ("amount",),
    "description": ("description", "narration", "type"),
    "currency": ("currency",),
}

# What a ledger export calls the same fields.
LEDGER_FIELDS: dict[str, str] = {
    "value_date": "as_of",
    "amount": "ledger_balance",
    "description": "account",
    "currency": "currency",
}


def find_column(columns: Sequence[str], *needles: str) -> str | None:
    """First column containing a needle: needle order first, then column order."""
    lowered = [(str(c).strip().lower(), c) for c in columns]
    return next((orig for n in needles for low, orig in lowered if n in low), None)


def detect_roles(columns: Sequence[str]) -> dict[str, str | None]:
    return {role: find_column(columns, *words) for role, words in ROLE_KEYWORDS.items()}


def usable_roles(roles: Mapping[str, str | None]) -> bool:
    return bool(roles["date"] and (roles["amount"] or (roles["debit"] and roles["credit"])))


def is_tape(columns: Sequence[str]) -> bool:
    return set(TAPE_KEY_FIELDS) <= set(columns)


def canonical(df: DataFrame) -> DataFrame:
    """Project onto the canonical schema; missing columns become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in TRANSACTION
        ]
    )


def resolve_tape(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rename a tape's own columns to the semantic ones; unmapped ones become null."""
    have = set(df.columns)
    keep = [F.col(c) for c in ("borrower", "seq", "account_ref") if c in have]
    fields = [
        (F.col(f"`{actual}`") if actual in have else F.lit(None).cast("string")).alias(semantic)
        for semantic, actual in columns.items()
    ]
    return df.select(*keep, *fields)


OUTSTANDING_PARTS = ("principal_outstanding", "interest_outstanding", "fee_outstanding", "penalty_outstanding")
_WHOLE_PARTS = ("principal_amount", "total_loan_amount")


def with_money(df: DataFrame, config: TapeColumns) -> DataFrame:
    """Tape money as numbers under the borrower's sign convention, with ``total_outstanding`` and ``paid``.

    Done in steps, so that each cell is parsed once.
    """
    types = {f.name: f.dataType for f in df.schema}
    names = [*OUTSTANDING_PARTS, *_WHOLE_PARTS]
    parsed = df.withColumns(
        {
            n: parse_money(F.col(n), isinstance(types[n], T.NumericType)) if n in types else F.lit(0.0)
            for n in names
        }
    )
    listed = sorted(config.negative_sign_borrowers)
    negative = F.col("borrower").isin(*listed) if listed else F.lit(False)
    signed = parsed.withColumns(
        {n: F.when(negative, F.abs(n)).otherwise(F.greatest(F.col(n), F.lit(0.0))) for n in OUTSTANDING_PARTS}
        | {n: F.when(negative, F.abs(n)).otherwise(F.col(n)) for n in _WHOLE_PARTS}
    )
    owed = F.col(OUTSTANDING_PARTS[0])
    for n in OUTSTANDING_PARTS[1:]:
        owed = owed + F.col(n)
    totals = signed.withColumn("total_outstanding", owed)
    return totals.withColumn("paid", F.greatest(F.lit(0.0), F.col("total_loan_amount") - F.col("total_outstanding")))


def tape_events(df: DataFrame, config: TapeColumns | None = None) -> DataFrame:
    """Loan tape -> a disbursement and a collection event per loan, in one pass.

    ``df`` has semantic column names plus ``borrower``; ``account_ref`` defaults
    to the borrower, ``seq`` to the loan's own order key.
    """
    config = config or TapeColumns()
    have = set(df.columns)
    account = F.col("account_ref") if "account_ref" in have else F.col("borrower")
    for optional in ("currency", "closure_date", "company_due_date", "seq"):
        if optional not in have:
            df = df.withColumn(optional, F.lit(None).cast("long" if optional == "seq" else "string"))
    begin = blank_to_null(F.col("begin_date"))
    later = first_present(F.col("closure_date"), F.col("company_due_date"))
    lean = with_money(df, config).select(
        "borrower", "seq", account.alias("account_ref"), clean(F.col("loan_id")).alias("loan_id"),
        F.coalesce(F.col("currency").cast("string"), F.lit("")).alias("currency"),
        begin.alias("begin"), later.alias("later"), F.abs("principal_amount").alias("principal"), "paid",
    ).withColumn("collected_on", F.coalesce("later", "begin"))

    def event(suffix: str, date: str, amount: str, direction: str, label: str, offset: int) -> Column:
        return F.when(
            (F.col(amount) != 0) & F.col(date).isNotNull(),
            F.struct(
                F.concat(F.lit("tape:"), F.col("account_ref"), F.lit(":"), F.col("loan_id"), F.lit(suffix)).alias("key"),
                F.col(date).alias("value_date"),
                F.col(amount).alias("amount"),
                F.lit(direction).alias("direction"),
                F.concat(F.lit(label), F.col("loan_id")).alias("description"),
                (F.col("seq") * 2 + offset).alias("event_seq"),
            ),
        )

    events = F.array(
        event(":disb", "begin", "principal", DIR_OUT, "disbursement:", 0),
        event(":coll", "collected_on", "paid", DIR_IN, "collections:", 1),
    )
    each = lean.select("borrower", "account_ref", "currency", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return canonical(
        each.select(
            "borrower", "account_ref", "currency", F.lit("tape").alias("sheet"), F.lit("tape").alias("source_type"),
            "e.key", "e.value_date", "e.amount", "e.direction", "e.description",
            F.lit(1.0).alias("confidence"), F.col("e.event_seq").alias("seq"),
        )
    )


def signed_amount(debit: Column | None, credit: Column | None, amount: Column | None) -> tuple[Column, Column]:
    """(amount, direction) of a statement row from parsed cells; null amount means the row is dropped.

    A debit or credit column decides when there is one (signs kept); otherwise the
    sign of the amount does.
    """
    if debit is not None or credit is not None:
        d = debit if debit is not None else F.lit(0.0)
        c = credit if credit is not None else F.lit(0.0)
        value = F.when(c != 0, c).when(d != 0, d)
        return value, F.when(c != 0, F.lit(DIR_IN)).when(d != 0, F.lit(DIR_OUT))
    if amount is None:
        return F.lit(None).cast("double"), F.lit(None).cast("string")
    kept = F.when(amount != 0, amount)
    return F.abs(kept), F.when(kept >= 0, F.lit(DIR_IN)).otherwise(F.lit(DIR_OUT))


def statement_rows(df: DataFrame, roles: Mapping[str, str | None], *, sheet: str = "bank", currency: str | None = None) -> DataFrame:
    """Bank or mobile-money table -> canonical rows.

    ``df`` carries ``account_ref`` and ``seq``; the sheet and a currency column
    are kept, unlike a fixed 'bank' label.
    """

    def role(name: str) -> Column | None:
        return F.col(f"`{roles[name]}`") if roles.get(name) else None

    # Each cell is parsed once, in a step of its own.
    types = {f.name: f.dataType for f in df.schema}
    parsed = {
        r: parse_money(role(r), isinstance(types[roles[r]], T.NumericType)) for r in ("debit", "credit", "amount") if role(r) is not None
    }
    if "amount" in parsed:
        parsed["amount"] = F.when(blank_to_null(role("amount")).isNotNull(), parsed["amount"])
    df = df.withColumns({f"_cell_{r}": c for r, c in parsed.items()})
    value, direction = signed_amount(*[F.col(f"_cell_{r}") if r in parsed else None for r in ("debit", "credit", "amount")])
    description = role("description")
    currency = currency or find_column(df.columns, "currency")
    rows = df.withColumn("amount_", value).withColumn("direction_", direction)
    rows = rows.filter(blank_to_null(role("date")).isNotNull() & F.col("amount_").isNotNull())
    borrower = F.col("borrower") if "borrower" in df.columns else F.lit(None).cast("string")
    return canonical(
        rows.select(
            borrower.alias("borrower"),
            F.concat(F.lit("bank:"), F.col("account_ref"), F.lit(":"), F.col("seq").cast("string")).alias("key"),
            F.lit(sheet).alias("sheet"), F.lit(sheet).alias("source_type"),
            role("date").cast("string").alias("value_date"),
            F.col("amount_").alias("amount"), F.col("direction_").alias("direction"),
            (clean(F.col(f"`{currency}`")) if currency else F.lit("")).alias("currency"),
            (F.coalesce(description.cast("string"), F.lit("")) if description is not None else F.lit("")).alias("description"),
            "account_ref", F.lit(1.0).alias("confidence"), "seq",
        )
    )


def simple_rows(df: DataFrame, *, sheet: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Simple date/amount/description table (a ledger, say) -> canonical rows.

    ``mapping`` names a column per canonical field and is honoured first. Money
    with thousands separators is read rather than dropped.
    """
    mapping = mapping or (LEDGER_FIELDS if sheet == "ledger" else {})
    have = set(df.columns)

    def pick(name: str) -> Column:
        names = dict.fromkeys([*([mapping[name]] if name in mapping else []), *SIMPLE_FIELDS[name]])
        found = [blank_to_null(F.col(f"`{n}`")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    number = plain_number(F.replace(pick("amount"), F.lit(","), F.lit("")))
    rows = df.withColumn("amount_", number).withColumn("date_", pick("value_date"))
    rows = rows.filter(F.col("amount_").isNotNull() & F.col("date_").isNotNull())
    borrower = F.col("borrower") if "borrower" in have else F.lit(None).cast("string")
    return canonical(
        rows.select(
            borrower.alias("borrower"),
            F.concat(F.lit(f"{sheet}:"), F.col("account_ref"), F.lit(":"), F.col("seq").cast("string")).alias("key"),
            F.lit(sheet).alias("sheet"), F.lit(sheet).alias("source_type"),
            F.col("date_").alias("value_date"), F.abs("amount_").alias("amount"),
            F.when(F.col("amount_") >= 0, F.lit(DIR_IN)).otherwise(F.lit(DIR_OUT)).alias("direction"),
            F.coalesce(pick("currency"), F.lit("")).alias("currency"),
            F.coalesce(pick("description"), F.lit("")).alias("description"),
            "account_ref", F.lit(1.0).alias("confidence"), "seq",
        )
    )


def combine(*frames: DataFrame) -> DataFrame:
    """Bag union of canonical frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def statement_currency(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """One currency per statement: its declared one, else that of its first row with one."""
    first = rows.filter(F.col("currency") != "").groupBy("account_ref").agg(F.min_by("currency", "seq").alias("row_currency"))
    return (
        shapes.select("account_ref", F.col("currency").alias("declared"))
        .join(first, "account_ref", "full")
        .select("account_ref", F.coalesce(F.nullif(F.col("declared"), F.lit("")), F.col("row_currency"), F.lit("")).alias("currency"))
    )


def stamp_currency(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Fill blank row currencies from the statement's declared one."""
    declared = shapes.select("account_ref", F.col("currency").alias("_declared"))
    return (
        rows.join(declared, "account_ref", "left")
        .withColumn("currency", F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.col("_declared"), F.lit("")))
        .drop("_declared")
    )


def flag_spot_checks(rows: DataFrame, floor: float) -> DataFrame:
    return rows.withColumn("needs_spot_check", F.coalesce(F.col("confidence"), F.lit(1.0)) < floor)


def in_periods(rows: DataFrame, periods: Sequence[str] | None) -> DataFrame:
    """Rows dated in one of the yyyy-MM months; undatable rows go; no list means no filter."""
    if not periods:
        return rows
    return rows.filter(F.date_format(parse_when(F.col("value_date")), "yyyy-MM").isin(*periods))


def in_cohort(
    tape: DataFrame,
    *,
    periods: Sequence[str] = (),
    products: Sequence[str] = (),
    countries: Sequence[str] = (),
) -> DataFrame:
    """Loan-tape rows of the chosen months, products and countries (all must hold)."""
    out = tape
    if periods:
        out = out.filter(F.date_format(parse_when(F.col("begin_date").cast("string")), "yyyy-MM").isin(*periods))
    if products:
        out = out.filter(F.col("product").cast("string").isin(*products))
    if countries:
        out = out.filter(F.col("country").cast("string").isin(*countries))
    return out


def pick_lists(tape: DataFrame) -> DataFrame:
    """Distinct months, products and countries, for filter lists; one scan."""
    pairs = F.array(
        F.struct(F.lit("period").alias("field"), F.date_format(parse_when(F.col("begin_date").cast("string")), "yyyy-MM").alias("value")),
        F.struct(F.lit("product").alias("field"), F.col("product").cast("string").alias("value")),
        F.struct(F.lit("country").alias("field"), F.col("country").cast("string").alias("value")),
    )
    return tape.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def category(description: Column, rules: Sequence[CategoryRule]) -> Column:
    """Label of the first rule that fits, else 'other'."""
    text = F.upper(F.coalesce(description, F.lit("")))
    out: Column | None = None
    for rule in rules:
        hit = F.lit(True)
        for token in rule.every:
            hit = hit & text.contains(token)
        if rule.either:
            some = F.lit(False)
            for token in rule.either:
                some = some | text.contains(token)
            hit = hit & some
        out = F.when(hit, rule.label) if out is None else out.when(hit, rule.label)
    return out.otherwise("other") if out is not None else F.lit("other")


def with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", month_key(F.col("value_date")))


def drop_repeats(rows: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """One row per transaction identity across statement files: the lowest ``seq`` stays.

    The minimum is combined map-side, so a transaction repeated in very many
    files does not pile up in one task.
    """
    cols = rows.columns
    scope = [k for k in keys if k in cols]
    identity = [
        F.coalesce(F.col("value_date"), F.lit("")).alias("_d"),
        F.col("amount").cast("decimal(28,2)").alias("_a"),
        F.lower(F.coalesce(F.col("direction"), F.lit(""))).alias("_dir"),
        ascii_alnum_key(F.col("description")).alias("_t"),
    ]
    kept = rows.groupBy(*scope, *identity).agg(F.min_by(F.struct(*cols), F.col("seq")).alias("_r"))
    return kept.select("_r.*")


def closing_balance(rows: DataFrame, keys: Sequence[str] = ("account_ref",)) -> DataFrame:
    """Last non-blank balance per statement; null when that cell is not a number."""
    present = rows.filter(blank_to_null(F.col("balance")).isNotNull())
    return present.groupBy(*keys).agg(plain_number(F.max_by(F.col("balance").cast("string"), F.col("seq"))).alias("closing_balance"))
