"""Numbered tables recovered from word positions.

Words of a page become visual lines inside the page's row (the anchor of a line
is its first word, which no window frame expresses; a small helper finds the
next anchor by binary search). Everything after
that is joins and prefix counts: the header in force, the cell of each word, and
which row a loose narration belongs to. For files that fit in a task these are
windows over one layout by file, so words are shuffled once and written nowhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyweave.functions.dates import month_name_date
from tallyweave.operators.ordered import HOT_ROWS, exclusive_prefix
from tallyweave.operators.statements import NUMBER, TABLE_WORDS, number_of
from tallyweave.schema import DIR_IN, DIR_OUT
from tallyweave.session import settle, sweep

# Generator and footer lines.
NOISE = (
    r"(?i)Generated on",
    r"(?i)api\.withmono\.com",
    r"(?i)All \d+ transactions",
    r"^\d+/\d+$",
    r"(?i)^Page\s+\d+\s+of\s+\d+",
)
_CELLS = {"#": "c0", "DATE": "c1", "NARRATION": "c2", "DEBIT": "c3", "CREDIT": "c4", "BALANCE": "c5"}


def line_starts(tops: Sequence[float], reach: float) -> list[int]:
    """Where lines begin among sorted ``tops``: each at the first word that lies more than ``reach`` below the line's first."""
    out, at = [], 0
    while at < len(tops):
        out.append(at)
        first = tops[at]
        at = bisect_right(tops, reach, lo=at + 1, key=lambda t: t - first)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _line_starts(tops: pd.Series, reach: pd.Series) -> pd.Series:
    return pd.Series([line_starts(t, r) for t, r in zip(tops, reach)], dtype=object)


def page_lines(words: DataFrame) -> DataFrame:
    """Words -> visual lines of a page, each sorted left to right: ``file, page, line_no, words``.

    A line reaches as far as half the page's median word height from its first
    word. A page bounds the group, and it is worked on inside its row: its words are
    sorted once, and each line is looked up once and cut out. Words without a place are left out.
    """
    word = F.struct("top", "x0", "text", "x1", "bottom")
    pages = words.filter(F.col("top").isNotNull()).groupBy("file", "page").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    heights = F.array_sort(F.transform("ws", lambda w: w["bottom"] - w["top"]))
    middle = F.get(heights, F.floor(F.size("ws") / 2).cast("int"))
    reach = F.greatest(F.lit(2.0), F.when(middle == 0, F.lit(7.0)).otherwise(middle) * 0.5)
    pages = pages.withColumn("starts", _line_starts(F.transform("ws", lambda w: w["top"]), reach))
    spans = F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.struct(a.alias("at"), F.coalesce(b, F.size("ws")).alias("end")))

    def line(span: Column) -> Column:
        own = F.slice(F.col("ws"), span["at"] + 1, span["end"] - span["at"])
        by_x = F.array_sort(F.transform(own, lambda w: F.struct(w["x0"].alias("x0"), w["top"].alias("top"), w["text"].alias("text"), w["x1"].alias("x1"))))
        return F.transform(by_x, lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1")))

    return pages.select("file", "page", F.posexplode(F.transform(spans, line)).alias("line_no", "words"))


def _marked_lines(lines: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    noise = F.lit(False)
    for pattern in NOISE:
        noise = noise | F.trim(F.col("line")).rlike(pattern)
    marked = lines.withColumn("line", text).withColumn("is_noise", noise).withColumn(
        "ups", F.transform("words", lambda w: F.upper(w["text"]))
    )
    # One column per step keeps the nested look-ups small.
    previous = F.lit(0)
    for k, word in enumerate(TABLE_WORDS):
        rest = F.slice(F.col("ups"), previous + 1, F.size("ups"))
        at = F.array_position(rest, word).cast("int")
        ok = at > 0 if k == 0 else (at > 0) & (previous > 0)
        marked = marked.withColumn(f"p{k}", F.when(ok, at + previous).otherwise(F.lit(0)))
        previous = F.col(f"p{k}")
    word_at = lambda k, edge: F.element_at("words", F.col(f"p{k}"))[edge]
    last = len(TABLE_WORDS) - 1
    borders = [(word_at(k, "x1") + word_at(k + 1, "x0")) / 2 for k in range(last)]
    is_header = ~F.col("is_noise") & (F.col(f"p{last}") > 0)
    return marked.withColumn("borders", F.when(is_header, F.array(*borders))).drop("ups", *[f"p{k}" for k in range(last + 1)])


def _cell(k: int) -> Column:
    """Texts of a line's words between the borders ``edges`` of column ``k``."""
    inf = F.lit(float("inf"))
    lo = F.element_at("edges", k) if k > 0 else -inf
    hi = F.element_at("edges", k + 1) if k < len(TABLE_WORDS) - 1 else inf
    inside = F.filter("words", lambda w: (w["x0"] >= lo) & (w["x0"] < hi))
    return F.transform(inside, lambda w: w["text"])


def _cells(lines: DataFrame, hot_rows: int) -> DataFrame:
    """Lines under a header, cut into cells, with the block they are in."""
    order = [F.col("page"), F.col("line_no")]
    flagged = lines.withColumn("is_header", F.col("borders").isNotNull().cast("int")).withColumn(
        "is_break", (F.col("is_noise") | F.col("borders").isNotNull()).cast("int")
    )
    counted = exclusive_prefix(flagged, ["file"], order, ["is_header", "is_break"], hot_rows=hot_rows)
    headers = counted.filter(F.col("is_header") == 1).select(
        "file", (F.col("is_header_before") + 1).cast("long").alias("header_no"), F.col("borders").alias("edges")
    )
    body = counted.filter((F.col("is_break") == 0) & (F.col("is_header_before") > 0)).select(
        "file", "page", "line_no", "words", F.col("rows_before").alias("at"),
        F.col("is_header_before").cast("long").alias("header_no"), F.col("is_break_before").cast("long").alias("block"),
    )
    placed = body.join(headers, ["file", "header_no"])
    return _with_events(placed.select("file", "at", "block", *[_cell(k).alias(f"c{k}") for k in range(len(TABLE_WORDS))]))


def _with_events(cells: DataFrame) -> DataFrame:
    number = F.array_join("c0", "")
    return cells.withColumn("row_no", number).withColumn(
        "is_event", (number.rlike(r"^\d+$") & (F.array_join("c1", "") != "")).cast("int")
    )


def _first_money(tokens: Column) -> Column:
    hits = F.filter(F.transform(tokens, lambda t: F.regexp_extract(t, NUMBER, 0)), lambda n: n != "")
    return number_of(F.get(hits, F.lit(0)))


def _assembled(cells: DataFrame, valid: Column, hot_rows: int) -> DataFrame:
    """Valid rows with their whole narration: loose lines before the first row of a block
    or after a row that was not kept lead the next row; others follow the row above."""
    flagged = cells.withColumn("is_valid", ((F.col("is_event") == 1) & valid).cast("int"))
    c = exclusive_prefix(flagged, ["file"], [F.col("at")], ["is_event", "is_valid"], hot_rows=hot_rows)
    c = settle(c.withColumns({"e": F.col("is_event_before").cast("long"), "v": F.col("is_valid_before").cast("long")}))
    rows = c.filter(F.col("is_valid") == 1).withColumn("row_id", F.col("v") + 1)
    last_event = c.filter(F.col("is_event") == 1).select(
        "file", (F.col("e") + 1).alias("e"), F.col("block").alias("event_block"), F.col("is_valid").alias("event_valid")
    )
    narration = F.trim(F.array_join("c2", " "))
    loose = (
        c.filter((F.col("is_event") == 0) & (narration != "")).join(last_event, ["file", "e"], "left")
        .withColumn("follows", F.coalesce((F.col("event_block") == F.col("block")) & (F.col("event_valid") == 1), F.lit(False)))
        .select("file", "block", "at", narration.alias("part"),
                F.when(F.col("follows"), F.col("v")).otherwise(F.col("v") + 1).alias("row_id"))
    )
    parts = loose.unionByName(rows.select("file", "block", "at", narration.alias("part"), "row_id")).filter(F.col("part") != "")
    # The group is the narration of one transaction.
    told = parts.groupBy("file", "block", "row_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), " ").alias("description")
    )
    return rows.join(told, ["file", "block", "row_id"], "left").withColumn("description", F.coalesce(F.col("description"), F.lit("")))


def _assembled_by_file(lines: DataFrame, money: dict[str, Column], valid: Column) -> DataFrame:
    """As :func:`_assembled` of :func:`_cells`, for files that each fit in a task: one layout by file serves every step."""
    before = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    is_header = F.col("borders").isNotNull()
    is_break = F.col("is_noise") | is_header
    # A table has the one header in force; what stands above the first is none of it.
    under = lines.filter(F.col("file").isNotNull()).select(
        "file", "page", "line_no", is_break.alias("is_break"), F.when(~is_break, F.col("words")).alias("words"),
        F.last("borders", ignorenulls=True).over(before).alias("edges"),
        F.coalesce(F.sum(is_break.cast("int")).over(before), F.lit(0).cast("long")).alias("block"),
    )
    body = under.filter(~F.col("is_break") & F.col("edges").isNotNull())
    cells = _with_events(body.select("file", "page", "line_no", "block", *[_cell(k).alias(f"c{k}") for k in range(len(TABLE_WORDS))]))
    c = cells.withColumns(money).withColumn("is_valid", ((F.col("is_event") == 1) & valid).cast("int"))
    event = F.when(F.col("is_event") == 1, F.struct("block", "is_valid"))
    c = c.withColumn("v", F.coalesce(F.sum("is_valid").over(before), F.lit(0).cast("long"))).withColumn("event", F.last(event, ignorenulls=True).over(before))
    follows = F.coalesce((F.col("event.block") == F.col("block")) & (F.col("event.is_valid") == 1), F.lit(False))
    shown = [*[f"c{k}" for k in range(len(TABLE_WORDS)) if k != 2], "row_no", *money]
    parts = c.filter((F.col("is_event") == 0) | (F.col("is_valid") == 1)).select(
        "file", "block", F.when((F.col("is_event") == 0) & follows, F.col("v")).otherwise(F.col("v") + 1).alias("row_id"),
        F.when(F.col("is_valid") == 1, F.struct(*shown)).alias("row"),
        F.struct("page", "line_no", F.trim(F.array_join("c2", " ")).alias("part")).alias("told"),
    ).filter(F.col("row").isNotNull() | (F.col("told.part") != ""))
    # The group is the narration of one transaction; without a row of its own block it is nobody's.
    told = F.filter(F.transform(F.array_sort(F.collect_list("told")), lambda p: p["part"]), lambda p: p != "")
    rows = parts.groupBy("file", "block", "row_id").agg(F.first("row", ignorenulls=True).alias("row"), F.array_join(told, " ").alias("description"))
    return rows.filter(F.col("row").isNotNull()).select("file", "block", "row_id", "row.*", "description")


def _rows(words: DataFrame, money: dict[str, Column], valid: Column, hot_rows: int) -> DataFrame:
    """Table rows of every file; those of more than ``hot_rows`` words are shared by many tasks."""
    hot = words.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select("file")
    hot = settle(hot)
    sweep(words.sparkSession)
    if hot.isEmpty():
        return _assembled_by_file(_marked_lines(page_lines(words)), money, valid)
    cold = _assembled_by_file(_marked_lines(page_lines(words.join(hot, "file", "left_anti"))), money, valid)
    spread = settle(_marked_lines(page_lines(words.join(hot, "file", "left_semi"))).drop("line"))
    large = _assembled(_cells(spread, hot_rows).withColumns(money), valid, hot_rows)
    return cold.unionByName(large.select(*cold.columns))


def table_rows(words: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Canonical rows of numbered tables, with ``balance``; a credit is read before a debit."""
    money = {"debit": _first_money(F.col("c3")), "credit": _first_money(F.col("c4")), "balance": _first_money(F.col("c5"))}
    rows = _rows(words, money, F.col("credit").isNotNull() | F.col("debit").isNotNull(), hot_rows)
    out = rows.select(
        F.concat(F.lit("bank:"), F.col("file"), F.lit(":"), F.col("row_id").cast("string")).alias("key"),
        F.lit("bank").alias("sheet"), F.lit("bank").alias("source_type"),
        month_name_date(F.array_join("c1", " ")).alias("value_date"),
        F.abs(F.coalesce(F.col("credit"), F.col("debit"))).alias("amount"),
        F.when(F.col("credit").isNotNull(), F.lit(DIR_IN)).otherwise(F.lit(DIR_OUT)).alias("direction"),
        F.lit("").alias("currency"), "description", F.col("file").alias("account_ref"), F.lit(1.0).alias("confidence"),
        F.col("row_id").alias("seq"), "balance", "file",
    )
    return out.withColumn("borrower", F.lit(None).cast("string"))


def raw_table(words: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same tables under their own header names, rows without money included."""
    rows = _rows(words, {}, F.lit(True), hot_rows)
    own = [F.trim(F.array_join(c, " ")).alias(name) for name, c in _CELLS.items() if name not in ("#", "NARRATION")]
    return rows.select("file", F.col("row_id").alias("seq"), F.col("row_no").alias("#"), own[0],
                       F.col("description").alias("NARRATION"), *own[1:])
