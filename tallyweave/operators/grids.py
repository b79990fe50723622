"""Tables whose header row has to be found, as rows of text cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import strip

# Words that mark a header row.
HEADER_WORDS = (
    "date", "amount", "debit", "credit", "balance", "description", "narration",
    "loan_id", "principal_amount", "total_loan_amount", "as_of", "ledger_balance",
)
HEADER_SCAN_ROWS = 10


def looks_like_header(cells: Column) -> Column:
    text = F.lower(F.array_join(F.filter(cells, lambda c: ~F.lower(strip(c)).isin("", "nan")), " "))
    hit = F.lit(False)
    for word in HEADER_WORDS:
        hit = hit | text.contains(word)
    return hit


def with_header(grid: DataFrame, keys: tuple[str, ...] = ("file",), *, detect: bool = True) -> DataFrame:
    """``file, seq, cells`` -> data rows with their ``header`` array; ``seq`` restarts below the header.

    The header is the first of the top ten rows that has a header word, else (or
    with ``detect=False``) the first row. Nothing but one row per file is joined.
    """
    top = grid.filter(F.col("seq") < (HEADER_SCAN_ROWS if detect else 1))
    found = top.groupBy(*keys).agg(
        F.min_by(F.struct("cells", "seq"), F.when(looks_like_header(F.col("cells")), F.col("seq")) if detect else F.col("seq")).alias("_h"),
        F.min_by(F.struct("cells", "seq"), F.col("seq")).alias("_first"),
    )
    named = found.select(*keys, F.coalesce("_h", "_first").alias("_h"))
    header = F.transform(F.col("_h.cells"), lambda c: strip(F.coalesce(c, F.lit(""))))
    return (
        grid.join(named, list(keys))
        .filter(F.col("seq") > F.col("_h.seq"))
        .withColumn("header", header)
        .withColumn("seq", F.col("seq") - F.col("_h.seq") - 1)
        .drop("_h")
    )


def cell_named(*needles: str) -> Column:
    """Cell under the first header containing a needle (needle order first), null when there is none.

    Works for any number of header layouts in one plan.
    """
    header = F.transform(F.col("header"), F.lower)

    def spots(needle: str) -> Column:
        return F.filter(F.transform(header, lambda h, i: F.when(h.contains(needle), i)), lambda i: i.isNotNull())

    return F.get(F.col("cells"), F.get(F.concat(*[spots(n) for n in needles]), F.lit(0)))


def has_named(*needles: str) -> Column:

    def named(needle: str) -> Column:
        return F.exists(F.col("header"), lambda h: F.lower(h).contains(needle))

    found = named(needles[0])
    for n in needles[1:]:
        found = found | named(n)
    return found


def stitch(tables: DataFrame) -> DataFrame:
    """Tables cut by page breaks -> one table per file.

    ``tables``: ``file, table_no, row_no, cells``. The first table with a header
    word and a row beneath it fixes the header; repeats of a header at the top of
    later tables and blank rows go; unnamed columns are 'Column i'.
    """
    # Cells go along only with the rows that may be a header, so the others are counted as numbers.
    sized = tables.groupBy("file", "table_no").agg(F.count(F.lit(1)).alias("rows"), F.min("row_no").alias("row_no"))
    named = tables.filter(looks_like_header(F.col("cells"))).select("file", "table_no", "row_no", F.col("cells").alias("top"))
    chosen = named.join(sized.filter(F.col("rows") >= 2), ["file", "table_no", "row_no"]).groupBy("file").agg(
        F.min_by(F.struct("table_no", "top"), F.col("table_no")).alias("_c")
    )
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    header = F.transform(
        F.col("_c.top"), lambda c, i: F.when(blank(c), F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(strip(c))
    )
    first_row = F.col("row_no") == 0
    body = (
        tables.join(chosen, "file").filter(F.col("table_no") >= F.col("_c.table_no"))
        .filter(~(first_row & looks_like_header(F.col("cells"))))
        .filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    )
    named = body.withColumn("header", header)
    keys = F.transform(
        F.sequence(F.lit(1), F.size("cells")),
        lambda i: F.coalesce(F.get(F.col("header"), i - 1), F.concat(F.lit("Column "), i.cast("string"))),
    )
    row = F.zip_with(keys, F.col("cells"), lambda k, v: F.struct(k.alias("column"), strip(v).alias("value")))
    return named.select("file", "table_no", "row_no", row.alias("row"))
