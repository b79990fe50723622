"""Loading any mix of files: what a file holds is told by its header and the sheet it was handed in for.

Headers are data here: files of any number of signatures are read, told apart
and normalised in one plan of three branches (tape, statement, simple table),
whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.config import TAPE_FIELDS, TAPE_KEY_FIELDS, TapeColumns
from tallyweave.operators.normalize import LEDGER_FIELDS, combine, simple_rows, tape_events
from tallyweave.sources.tables import _stem, is_statement, read_raw_table, statement_cells

SHEETS_OF_STATEMENTS = ("bank", "mobile_money")


def bare_path(path: Column) -> Column:
    """A path without file system and escapes, as readers and listings may spell it differently."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def named_exactly(name: Column) -> Column:
    """Cell under the header ``name``, null when there is none."""
    at = F.array_position(F.col("header"), name)
    return F.get(F.col("cells"), F.when(at > 0, at - 1).cast("int"))


def actual_name(semantic: str, columns: TapeColumns) -> Column:
    """What a row's borrower calls a semantic field. Overrides are configuration, so the expression is as long as that."""
    out = F
    for borrower, names in sorted(columns.overrides.items()):
        if semantic in names:
            out = out.when(F.col("borrower") == borrower, F.lit(names[semantic]))
    default = F.lit(columns.default.get(semantic, semantic))
    return default if out is F else out.otherwise(default)


def kind_of(columns: TapeColumns) -> Column:
    """'tape', 'statement' or 'simple', from ``sheet``, ``borrower`` and ``header``."""
    tape = F.col("sheet") == "tape"
    for f in TAPE_KEY_FIELDS:
        tape = tape & F.array_contains(F.col("header"), actual_name(f, columns))
    return F.when(tape, "tape").when(F.col("sheet").isin(*SHEETS_OF_STATEMENTS) & is_statement(), "statement").otherwise("simple")


def read_files(spark: SparkSession, files: DataFrame, columns: TapeColumns | None = None) -> DataFrame:
    """``file, borrower, sheet, seq, header, cells, kind`` of all files of ``files`` (``file, borrower, sheet``).

    The list of paths is read on the driver, as a reader needs it; rows and headers are not.
    Missing files contribute nothing, and documents that are no tables are passed over.
    """
    tables = files.filter(F.lower("file").rlike(r"\.(csv|tsv|txt)$"))
    paths = [r.file for r in tables.select("file").distinct().orderBy("file").collect()]
    raw = read_raw_table(spark, paths, detect_header=True) if paths else None
    if raw is None:
        return files.select("file", "borrower", "sheet", F.lit(0).cast("long").alias("seq"), F.array().cast("array<string>").alias("header"),
                            F.array().cast("array<string>").alias("cells"), F.lit("simple").alias("kind")).limit(0)
    listed = tables.select(bare_path(F.col("file")).alias("_path"), "borrower", "sheet").distinct()
    return raw.withColumn("_path", bare_path(F.col("file"))).join(listed, "_path").drop("_path").withColumn("kind", kind_of(columns or TapeColumns()))


def file_kinds(rows: DataFrame) -> DataFrame:
    """``file, borrower, sheet, kind, signature, rows``: how each file was understood, for review before loading."""
    signature = F.md5(F.array_join("header", "\u001f"))
    return rows.groupBy("file", "borrower", "sheet", "kind", signature.alias("signature")).agg(F.count(F.lit(1)).alias("rows"))


def load_normalized(spark: SparkSession, files: DataFrame, columns: TapeColumns | None = None) -> DataFrame:
    """Files of all sheets and borrowers -> canonical rows.

    A tape is a file handed in as one whose header has the key columns, under the
    names that its borrower gives them; each loan becomes its events. Bank
    and mobile-money files with roles are statements. All else is a simple
    table of date, amount, description and currency; a ledger's own names are known.
    """
    columns = columns or TapeColumns()
    rows = read_files(spark, files, columns)
    account = _stem(F.col("file")).alias("account_ref")
    # Tapes: the semantic columns, picked per row by its borrower's names.
    tape = rows.filter("kind = 'tape'").select(
        "borrower", account, "seq", *[named_exactly(actual_name(f, columns)).alias(f) for f in TAPE_FIELDS]
    )
    events = tape_events(tape, columns)
    statements = statement_cells(rows.filter("kind = 'statement'"), F.col("sheet")).drop("balance")
    names = dict.fromkeys([*LEDGER_FIELDS.values(), "value_date", "date", "amount", "description", "narration", "type", "currency"])
    lower = F.transform(F.col("header"), F.lower)

    def cell(name: str) -> Column:
        at = F.array_position(lower, name)
        return F.get(F.col("cells"), F.when(at > 0, at - 1).cast("int")).alias(name)

    plain = rows.filter("kind = 'simple'").select("borrower", "sheet", account, "seq", *[cell(n) for n in names])
    known = ("ledger", "tape", *SHEETS_OF_STATEMENTS)
    simple = [simple_rows(plain.filter(F.col("sheet") == s), sheet=s) for s in known]
    other = simple_rows(plain.filter(~F.col("sheet").isin(*known)), sheet="other")
    return combine(events, statements, *simple, other)
