"""Currency conversion (left join to a small rate table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyweave.config import FxPolicy
from tallyweave.session import pin

RATES = T.StructType([T.StructField("currency", T.StringType()), T.StructField("rate", T.DoubleType())])


def static_rates(spark: SparkSession, policy: FxPolicy) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in policy.rates.items()], RATES)


def feed_rates(feed: DataFrame, base: str = "USD") -> DataFrame:
    """Landed feed rows (``json``: currency units per one base unit) -> base units per currency unit.

    Of several days the latest counts, so a code has one rate.
    """
    parsed = feed.select(
        F.get_json_object("json", "$.date").alias("as_of"),
        F.from_json(
            F.get_json_object("json", f"$.{base.strip().lower()}"), T.MapType(T.StringType(), T.DoubleType())
        ).alias("m"),
    )
    each = parsed.select("as_of", F.explode("m").alias("code", "per_base")).filter(F.col("per_base") > 0)
    rated = each.select(F.upper(F.trim("code")).alias("currency"), (1.0 / F.col("per_base")).alias("rate"), "as_of")
    return one_per_code(rated)


def one_per_code(rates: DataFrame) -> DataFrame:
    """One row per currency: the latest where rates are dated; else equal repetitions are
    one, and rates that contradict each other raise, since none may be guessed."""
    if "as_of" in rates.columns:
        last = F.max_by(F.struct("rate", "as_of"), F.struct("as_of", "rate")).alias("_r")
        return rates.groupBy("currency").agg(last).select("currency", "_r.rate", "_r.as_of")
    clash = F.raise_error(F.concat(F.lit("two rates for "), F.col("currency"))).cast("double")
    return rates.groupBy("currency").agg(F.min("rate").alias("_low"), F.max("rate").alias("_high")).select(
        "currency", F.when(F.col("_low") != F.col("_high"), clash).otherwise(F.col("_high")).alias("rate")
    )


def overlay_rates(live: DataFrame, static: DataFrame) -> DataFrame:
    """Live rates win where both have a currency."""
    cols = ["currency", "rate"]
    return (
        live.select(*cols, F.lit("live").alias("source"))
        .unionByName(static.join(live, "currency", "left_anti").select(*cols, F.lit("static").alias("source")))
    )


def currency_code(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def convert(df: DataFrame, rates: DataFrame, base: str = "USD", amount: str = "amount") -> DataFrame:
    """Add ``amount_base``, ``currency_code`` and ``unmapped_currency``.

    A code has one rate (see :func:`one_per_code`), so no row is multiplied.
    Blank or base code: unchanged. Known: multiplied. Unknown: unchanged and the
    code reported, never guessed.
    """
    table = pin(one_per_code(rates).select(F.col("currency").alias("_code"), F.col("rate").alias("_rate")))
    code = F.col("currency_code")
    as_is = (code == "") | (code == base)
    value = F.coalesce(F.col(amount), F.lit(0.0))
    return (
        df.withColumn("currency_code", currency_code(F.col("currency")))
        .join(table, F.col("currency_code") == F.col("_code"), "left")
        .withColumn("amount_base", F.when(as_is | F.col("_rate").isNull(), value).otherwise(value * F.col("_rate")))
        .withColumn("unmapped_currency", F.when(~as_is & F.col("_rate").isNull(), code))
        .drop("_code", "_rate")
    )


def currencies_to_fetch(df: DataFrame, base: str = "USD") -> DataFrame:
    """Distinct non-blank, non-base codes present in the rows."""
    return (
        df.select(currency_code(F.col("currency")).alias("currency"))
        .filter(~F.col("currency").isin("", base))
        .distinct()
    )
