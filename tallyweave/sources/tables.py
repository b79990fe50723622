"""File sources: CSV and text grids, statement text, tapes, inbox listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyweave.functions.money import parse_money
from tallyweave.functions.text import blank_to_null, clean
from tallyweave.operators.grids import cell_named, has_named, with_header
from tallyweave.operators.normalize import ROLE_KEYWORDS, canonical, signed_amount
from tallyweave.operators.ordered import with_ordinal
from tallyweave.schema import DIR_IN, DIR_OUT

# File kinds an inbox may hold.
INBOX_SUFFIXES = ("pdf", "csv", "tsv", "xlsx", "xls")


def _stem(path: Column) -> Column:
    """File name without folder and suffix."""
    return F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/"), -1), r"\.[^.]*$", "")


def _csv(spark: SparkSession, columns: list[str], paths: str | Sequence[str], separator: str):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema).option("header", False).option("sep", separator).option("mode", "PERMISSIVE")
        .option("quote", '"').option("escape", '"').option("multiLine", True).option("columnNameOfCorruptRecord", "_whole")
        .option("ignoreMissingFiles", True).csv(paths if isinstance(paths, str) else list(paths))
    )


def existing(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Those of the paths (globs allowed) that are there; a reader refuses the others."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for path in [paths] if isinstance(paths, str) else paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        if found is not None and len(found):
            out.append(path)
    return out


def grid_width(spark: SparkSession, paths: str | Sequence[str], separator: str = ",") -> int:
    """No record of the files has more cells than this (quoted separators count too). One number comes to the driver."""
    # Read with one column, a longer record is handed over as it stands.
    raw = _csv(spark, ["first", "_whole"], paths, separator)
    more = F.length("_whole") - F.length(F.replace(F.col("_whole"), F.lit(separator), F.lit("")))
    most = raw.agg(F.max(F.coalesce(more, F.lit(0))), F.count("first")).first()[0]
    return 1 + (most or 0) // len(separator)


def read_grid(spark: SparkSession, paths: str | Sequence[str], *, separator: str = ",") -> DataFrame:
    """CSV/TXT files as rows of text cells: ``file, seq, cells`` (all text, header row included).

    The width is that of the longest record, read first. Quoted cells may hold
    separators, doubled quotes and line breaks; for that a file is read by one
    task. ``file`` is the full path, so files of one name in two folders stay
    apart. ``seq`` is the position in the file. Missing files contribute
    nothing; a file that cannot be read to its end fails the read, so no part of
    one is taken for the whole.
    """
    paths = existing(spark, paths)
    if not paths:
        return spark.createDataFrame([], "file string, seq long, cells array<string>")
    names = [f"c{i}" for i in range(grid_width(spark, paths, separator))]
    raw = _csv(spark, names, paths, separator)
    placed = raw.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_row"), F.array(*names).alias("cells"),
    )
    ordered = with_ordinal(placed, ["file"], [F.col("_row")], "seq")
    used = F.size(F.filter(F.col("cells"), lambda c: c.isNotNull()))
    return ordered.filter(used > 0).select("file", "seq", "cells")


def read_raw_table(spark: SparkSession, paths: str | Sequence[str], *, detect_header: bool = False) -> DataFrame:
    """``file, seq, header, cells`` under the files' own column names."""
    return with_header(read_grid(spark, paths), detect=detect_header)


def _roles() -> dict[str, Column]:
    return {role: cell_named(*words) for role, words in ROLE_KEYWORDS.items()}


def load_statements(spark: SparkSession, paths: str | Sequence[str], *, sheet: str = "bank", detect_header: bool = False) -> DataFrame:
    """Statement files of any mix of layouts -> canonical rows plus ``balance``, in one plan.

    Columns take roles by keyword per file. A file without usable roles is read as
    a simple date/amount table. The account is the file name without its suffix;
    a key also names the folder where several files share that name.
    """
    return statement_cells(read_raw_table(spark, paths, detect_header=detect_header), F.lit(sheet))


def _sides() -> tuple[Column, Column]:
    return has_named(*ROLE_KEYWORDS["debit"]), has_named(*ROLE_KEYWORDS["credit"])


def is_statement() -> Column:
    """Whether a row's header has a date and an amount, or a date and both sides."""
    has_debit, has_credit = _sides()
    return has_named(*ROLE_KEYWORDS["date"]) & (has_named(*ROLE_KEYWORDS["amount"]) | (has_debit & has_credit))


def statement_cells(table: DataFrame, sheet: Column) -> DataFrame:
    """``file, seq, header, cells`` of statements -> canonical rows plus ``balance`` (see :func:`load_statements`)."""
    r, usable = _roles(), is_statement()
    has_debit, has_credit = _sides()
    kept_borrower = F.col("borrower") if "borrower" in table.columns else F.lit(None).cast("string")
    table = table.withColumns({"borrower": kept_borrower, "sheet": sheet})
    table = table.withColumns({f"_{n}": parse_money(r[n]) for n in ("debit", "credit", "amount")})
    split_value, split_dir = signed_amount(F.col("_debit"), F.col("_credit"), None)
    one_value, one_dir = signed_amount(None, None, F.col("_amount"))
    exact = lambda *names: F.coalesce(*[_cell_exact(n) for n in names])
    simple = F.replace(exact("amount"), F.lit(","), F.lit("")).try_cast("double")
    split = has_debit | has_credit
    value = F.when(usable, F.when(split, split_value).otherwise(one_value)).otherwise(F.abs(simple))
    direction = F.when(usable, F.when(split, split_dir).otherwise(one_dir)).otherwise(
        F.when(simple >= 0, F.lit(DIR_IN)).otherwise(F.lit(DIR_OUT))
    )
    date = F.when(usable, r["date"]).otherwise(exact("value_date", "date"))
    description = F.when(usable, r["description"]).otherwise(exact("description", "narration", "type"))
    rows = table.select(
        "file", "borrower", "sheet", _stem(F.col("file")).alias("account_ref"), "seq", date.alias("value_date"), value.alias("amount"),
        direction.alias("direction"), F.coalesce(description, F.lit("")).alias("description"),
        clean(cell_named("currency")).alias("currency"), r["balance"].alias("balance"),
    ).filter(blank_to_null(F.col("value_date")).isNotNull() & F.col("amount").isNotNull())
    # One row per file: which names are taken twice.
    folders = table.select("file").distinct().groupBy(_stem(F.col("file")).alias("account_ref")).agg(F.count("*").alias("_files"))
    rows = rows.join(folders, "account_ref")
    place = F.when(F.col("_files") > 1, F.concat(F.lit("@"), F.substring(F.md5("file"), 1, 12))).otherwise("")
    keyed = rows.withColumns(
        {
            "key": F.concat(F.lit("bank:"), F.col("account_ref"), place, F.lit(":"), F.col("seq").cast("string")),
            "source_type": F.col("sheet"), "confidence": F.lit(1.0),
        }
    )
    return keyed.select(*canonical(keyed).columns, "balance")


def _cell_exact(name: str) -> Column:
    at = F.array_position(F.transform(F.col("header"), F.lower), name)
    return blank_to_null(F.get(F.col("cells"), F.when(at > 0, at - 1).cast("int")))


def read_statement_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Extracted statement text, one row per file; ``file`` is the full path."""
    return spark.read.option("wholetext", True).text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )


def scan_tape(
    tape: DataFrame, *, borrower: str | None = None, date_column: str = "begin_date",
    date_from: str | None = None, date_to: str | None = None, limit: int = 0,
) -> DataFrame:
    """Borrower, date range and row limit of a tape, all of which reach the scan. 0 = full tape."""
    df = tape
    if borrower is not None:
        df = df.filter(F.col("borrower") == borrower)
    if date_from:
        df = df.filter(F.col(date_column) >= date_from)
    if date_to:
        df = df.filter(F.col(date_column) <= date_to)
    return df.limit(limit) if limit > 0 else df


def read_tape(spark: SparkSession, path: str, **choice: object) -> DataFrame:
    """Tape store, partitioned by ``borrower`` (see :func:`scan_tape`)."""
    return scan_tape(spark.read.parquet(path), **choice)


def list_borrowers(tape: DataFrame) -> DataFrame:
    return tape.select("borrower").distinct().orderBy("borrower")


def list_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Statement files, newest first, with the fingerprint ``path@modified`` (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    return inbox_of(
        files.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"),
                     F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("modified_at"))
    )


def inbox_of(files: DataFrame) -> DataFrame:
    """Supported kinds only, newest first."""
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    return (
        files.filter(suffix.isin(*INBOX_SUFFIXES))
        .withColumn("fingerprint", F.concat_ws("@", "file_id", "modified_at"))
        .orderBy(F.desc("modified_at"), "file_id")
    )


def load_register(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Collateral register: plate, borrower, expected owner and vehicle by keyword; blank plates go."""
    t = read_raw_table(spark, paths)
    plate = cell_named("plate", "registration", "asset_id", "asset id")
    return t.select(
        clean(plate).alias("plate"), clean(cell_named("borrower")).alias("borrower"),
        clean(cell_named("expected_owner", "expected owner", "owner", "propietario")).alias("expected_owner"),
        clean(cell_named("expected_vehicle", "expected vehicle", "vehicle")).alias("expected_vehicle"),
        F.col("file").alias("source_file"), "seq",
    ).filter(F.col("plate") != "")


def latest_results(rows: DataFrame) -> DataFrame:
    """One registry result per plate: the later file, then the later row. ``rows`` has file_order, seq."""
    fields = [c for c in rows.columns if c not in ("plate", "file_order", "seq")]
    last = F.max_by(F.struct(*fields), F.struct("file_order", "seq"))
    return rows.filter(F.col("plate") != "").groupBy("plate").agg(last.alias("_r")).select("plate", "_r.*")


def load_registry_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Registry results: the first column is the plate, other fields by keyword, the latest wins."""
    # Keywords per field.
    words = {
        "status": ("status",), "owner": ("propietario", "owner"), "state": ("estado",),
        "brand": ("marca", "make"), "model": ("modelo", "model"), "verified_date": ("verified date", "verified_date"),
    }
    t = read_raw_table(spark, paths)
    # A path is given with or without its file system; the longest one that ends the file's path is meant.
    bare = [p.split("://", 1)[-1].split(":", 1)[-1] for p in paths]
    place = F.lit(None).cast("int")
    for k, p in sorted(enumerate(bare), key=lambda x: len(x[1])):
        place = F.when(F.endswith(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), F.lit(p)), F.lit(k)).otherwise(place)
    rows = t.select(
        clean(F.get(F.col("cells"), F.lit(0))).alias("plate"), *[clean(cell_named(*w)).alias(f) for f, w in words.items()],
        place.alias("file_order"), "seq",
    )
    return latest_results(rows)
