"""Ordered per-group arithmetic that survives one group holding most of the rows.

A window over a key sends the whole key to one task. Here a key larger than
``hot_rows`` is instead laid out in sorted ranges that many tasks share: each
range is summed, the few range totals are prefix-summed per key, and the carry
is added back to a window inside the range. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.functions.money import EXACT
from tallyweave.session import cut, pin, settle

HOT_ROWS = 2_000_000
_SUM = "decimal(38,10)"


def _ranges_for(df: DataFrame, rows: int, hot_rows: int) -> int:
    """Enough ranges that none holds more than about half of ``hot_rows``."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, 2 * rows // max(hot_rows, 1) + 1)


def _zero() -> Column:
    return F.lit(0).cast(_SUM)


def _with_prefix(df: DataFrame, keys: list[str], order: list[Column], values: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{v}_before": F.coalesce(F.sum(F.col(v).cast(EXACT)).over(w), _zero()).cast(_SUM) for v in values}
    return df.withColumns({"rows_before": F.count(F.lit(1)).over(w), **sums})


def exclusive_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Sequence[str] = (),
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``rows_before`` and, per value, ``<value>_before``: count and sum of the same key's earlier rows.

    ``order`` must be total within a key. The sizes of the keys above
    ``hot_rows`` are read first: a list no longer than total rows / hot_rows.
    """
    keys, order = list(keys), list(order)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    found = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not found[0]:
        return _with_prefix(df, keys, order, values)

    marked = pin(hot.select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cold = _with_prefix(df.join(marked, same, "left_anti"), keys, order, values)

    # The range borders come from a sample, so they are fixed before they are used twice.
    laid_out = cut(
        df.join(marked, same, "left_semi")
        .repartitionByRange(_ranges_for(df, found[1], hot_rows), *[F.col(k) for k in keys], *order)
        .withColumn("_range", F.spark_partition_id())
    )
    per_range = laid_out.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(F.col(v).cast(EXACT)).alias(f"_s_{v}") for v in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_k_range"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_carry"),
        *[F.coalesce(F.sum(f"_s_{v}").over(earlier).cast(_SUM), _zero()).alias(f"_carry_{v}") for v in values],
    )
    local = _with_prefix(laid_out, [*keys, "_range"], order, values)
    joined = local.join(carry, [*same, F.col("_range") == F.col("_k_range")]).withColumns(
        {
            "rows_before": F.col("rows_before") + F.col("_carry"),
            **{f"{v}_before": (F.col(f"{v}_before") + F.col(f"_carry_{v}")).cast(_SUM) for v in values},
        }
    )
    return cold.unionByName(joined.select(*cold.columns))


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Zero-based position within a key."""
    return exclusive_prefix(df, keys, order, hot_rows=hot_rows).withColumnRenamed("rows_before", name)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value of the row before, within a key.

    ``lag`` where a key fits one task; rows of keys above ``hot_rows`` meet their
    neighbour by ordinal, so no such key is gathered.
    """
    keys, order = list(keys), list(order)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    lagged = F.lag(F.col(value)).over(Window.partitionBy(*keys).orderBy(*order))
    if hot.isEmpty():
        return df.withColumn(name, lagged)
    marked = pin(hot.select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cold = df.join(marked, same, "left_anti").withColumn(name, lagged)
    placed = with_ordinal(df.join(marked, same, "left_semi"), keys, order, "_at", hot_rows=hot_rows)
    before = placed.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_at") + 1).alias("_next"), F.col(value).alias(name)
    )
    joined = placed.join(before, [*same, F.col("_at") == F.col("_next")], "left")
    return cold.unionByName(joined.select(*cold.columns))


def _magnitude_bin(v: Column) -> Column:
    """Order-preserving bin that keeps the first four digits of the cents: at most 9,000 per decade."""
    cents = F.floor(F.abs(v) * 100).cast("double")
    width = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(cents)) - 3, F.lit(0)))
    low = F.when(cents < 1, F.lit(0.0)).otherwise(F.floor(cents / width).cast("double") * width)
    return F.when(v < 0, -low).otherwise(low)


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", *, which: str = "mean", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact median per key: the mean of the two middle values, or with ``which="upper"`` the upper one.

    Values are counted into a histogram (combined map-side), the histogram into
    bins, and only the bins that hold a middle value are opened. No task sees
    more than one key's bins; a bin with very many distinct values is laid out
    over many tasks.
    """
    keys = list(keys)
    hist = (
        df.select(*keys, F.coalesce(F.col(value), F.lit(0.0)).alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bin", _magnitude_bin(F.col("_v")))
    )
    bins = hist.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"))
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)  # zero-based middles
    opened = (
        bins.withColumn("_n", F.sum("_bc").over(by_key))
        .withColumn("_before", F.coalesce(F.sum("_bc").over(running), F.lit(0)))
        .filter((F.col("_before") <= hi) & (F.col("_before") + F.col("_bc") > lo))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_k__bin"), "_n", "_before")
    )
    # Null-safe equality adds no filter to one side only, so both read one histogram exchange.
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_bin"]]
    # Written once: the few values of the opened bins are sized first and then laid out.
    inside = settle(hist.join(opened, same).select(*keys, "_bin", "_v", "_c", "_n", "_before"))
    placed = (
        exclusive_prefix(inside, [*keys, "_bin"], [F.col("_v")], ["_c"], hot_rows=hot_rows)
        .withColumn("_from", F.col("_before") + F.col("_c_before").cast("long"))
        .withColumn("_to", F.col("_from") + F.col("_c"))
    )
    pick_lo = F.max(F.when((F.col("_from") <= lo) & (F.col("_to") > lo), F.col("_v")))
    pick_hi = F.max(F.when((F.col("_from") <= hi) & (F.col("_to") > hi), F.col("_v")))
    middle = pick_hi if which == "upper" else (pick_lo + pick_hi) / 2
    return placed.groupBy(*keys).agg(middle.alias(name))
