"""Rules that judge a group of rows: duplicates, round-trips, structuring.

Groups are only ever aggregated with mergeable functions; their rows are found
again by a join, so no group is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.config import Thresholds
from tallyweave.functions.money import exact_sum, to_double
from tallyweave.functions.text import thousands
from tallyweave.operators.ordered import exact_median
from tallyweave.operators.rules.base import Findings, Prepared, exception_id
from tallyweave.session import settle


def _exceptions(groups: DataFrame, rule: str, severity: float, description: Column) -> DataFrame:
    return groups.select(
        "borrower", "id", F.lit("anomaly").alias("kind"), F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"), description.alias("description"),
        "evidence_count", "first_evidence", F.lit("pending").alias("status"),
    )


def duplicates(p: Prepared, limits: Thresholds) -> Findings:
    """Same text, amount to the cent and date, more than once."""
    keyed = p.rows.select(
        "borrower", "key", "seq", "description", F.col("amt").cast("decimal(28,2)").alias("cents"),
        F.coalesce(F.col("value_date"), F.lit("")).alias("day"),
    )
    identity = ["borrower", "description", "cents", "day"]
    groups = (
        keyed.groupBy(*identity)
        .agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("evidence_count"),
             F.min_by("key", F.when(F.col("key").isNotNull(), F.col("seq"))).alias("first_evidence"))
        .filter(F.col("n") > 1)
        .withColumn("id", exception_id("dup", F.coalesce(F.col("first_evidence"), F.xxhash64(*identity).cast("string"))))
    )
    groups = settle(groups)
    text = F.concat(
        F.lit("Duplicate transaction: '"), F.col("description"), F.lit("' "), thousands(F.col("cents"), 2),
        F.lit(" on "), F.col("day"), F.lit(" appears "), F.col("n").cast("string"), F.lit("x"),
    )
    evidence = (
        keyed.filter(F.col("key").isNotNull())
        .join(groups.select(*identity, "id"), identity)
        .select("borrower", F.col("id").alias("exception_id"), F.col("key").alias("evidence_key"))
    )
    return Findings(_exceptions(groups, "dup", 0.5, text), evidence)


def round_trips(p: Prepared, limits: Thresholds) -> Findings:
    """A loan disbursed and collected on the same date: last disbursement, first collection."""
    out, back = F.col("description").startswith("disbursement:"), F.col("description").startswith("collections:")
    legs = p.rows.filter(out | back).select(
        "borrower", "seq", "key", "value_date", out.alias("is_out"),
        F.expr("substring(description, instr(description, ':') + 1)").alias("loan_id"),
    )
    leg = F.struct(F.col("key").alias("key"), F.coalesce(F.col("value_date"), F.lit("")).alias("day"))
    pairs = (
        legs.groupBy("borrower", "loan_id")
        .agg(F.max_by(leg, F.when(F.col("is_out"), F.col("seq"))).alias("d"),
             F.min_by(leg, F.when(~F.col("is_out"), F.col("seq"))).alias("c"))
        .filter(F.col("d.day").isNotNull() & (F.col("d.day") != "") & (F.col("d.day") == F.col("c.day")))
        .withColumn("keys", F.filter(F.array(F.col("d.key"), F.col("c.key")), lambda k: k.isNotNull()))
        .withColumn("evidence_count", F.size("keys").cast("long"))
        .withColumn("first_evidence", F.coalesce(F.col("d.key"), F.col("c.key")))
        .withColumn("id", exception_id("roundtrip", F.col("loan_id")))
    )
    text = F.concat(
        F.lit("Same-day disbursement and collection for loan "), F.col("loan_id"), F.lit(" on "), F.col("d.day"),
        F.lit(" (round-tripping)"),
    )
    evidence = pairs.select("borrower", F.col("id").alias("exception_id"), F.explode("keys").alias("evidence_key"))
    return Findings(_exceptions(pairs, "roundtrip", 0.8, text), evidence)


def structuring(p: Prepared, limits: Thresholds) -> Findings:
    """Several similar amounts on one account and day that add up to a material total.

    The upper middle value is found by counting, not by gathering the group:
    a value is high enough to be it when fewer than half of the rows are below,
    and low enough when more than half are at or below.
    """
    tol = limits.micro_split_amount_tolerance_pct
    day = F.substring(F.coalesce(F.col("value_date"), F.lit("")), 1, 10)
    rows = p.rows.withColumn("day", day).filter((F.col("account_ref") != "") & (F.col("day") != ""))
    group = ["borrower", "account_ref", "day"]
    sized = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("amt").alias("lo"), F.max("amt").alias("hi"),
        exact_sum(F.col("amt")).alias("total_exact"),
        F.count("key").alias("evidence_count"),
        F.min_by("key", F.when(F.col("key").isNotNull(), F.col("seq"))).alias("first_evidence"),
    )
    # A wide group can never pass, so it is left out before its rows are looked at again.
    possible = (
        p.with_median(sized)
        .withColumn("total", F.col("total_exact").cast("double"))
        .filter((F.col("n") >= limits.micro_split_min_count) & (F.col("hi") > 0) & (F.col("median_amt") > 0))
        .filter(F.col("total") > F.col("median_amt") * limits.micro_split_materiality_multiple)
        .filter(F.col("hi") * (1 - tol) <= F.col("lo") * (1 + tol) * (1 + 1e-9))
    )
    possible = settle(possible)
    members = rows.join(possible.select(*group, "lo", "hi", "n"), group)
    amt, half = F.col("amt"), F.floor(F.col("n") / 2)
    judged = members.groupBy(*group).agg(
        F.count_if(~((F.col("hi") - amt) <= amt * tol)).alias("too_low"),
        F.count_if((amt - F.col("lo")) <= amt * tol).alias("not_high"),
        F.max(half).alias("half"),
    ).filter((F.col("too_low") <= F.col("half")) & (F.col("not_high") >= F.col("half") + 1))
    middle = upper_median(members.join(judged.select(*group), group, "left_semi"), group, "amt", "middle")
    hits = possible.join(middle, group).filter(F.col("middle") > 0).withColumn(
        "id", exception_id("microsplit", F.concat_ws("|", "account_ref", "day"))
    )
    text = F.concat(
        F.lit("Possible structuring on account '"), F.col("account_ref"), F.lit("' on "), F.col("day"), F.lit(": "),
        F.col("n").cast("string"), F.lit(" similar-size transactions (~"), thousands(F.col("middle"), 2),
        F.lit(" each) totaling "), thousands(to_double(F.col("total_exact")), 2),
    )
    evidence = (
        rows.filter(F.col("key").isNotNull()).join(hits.select(*group, "id"), group)
        .select("borrower", F.col("id").alias("exception_id"), F.col("key").alias("evidence_key"))
    )
    return Findings(_exceptions(hits, "microsplit", 0.85, text), evidence)


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The upper of the two middle values per key."""
    return exact_median(df, keys, value, name, which="upper")
