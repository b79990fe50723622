"""Pledged assets against an independent registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import clean, containment_verdict, lookup_status, name_key
from tallyweave.operators.aggregate import coverage

# Display columns of the verification sheet, in order.
SHEET_COLUMNS = (
    ("plate", "Plate"), ("brand", "Brand"), ("model", "Model"), ("year", "Year"), ("vin", "VIN"),
    ("owner", "Owner"), ("color", "Color"), ("status", "Status"), ("verdict", "Verdict"),
    ("expected_vehicle", "Expected vehicle"), ("verified_date", "Verified Date"),
)


def verify(expected: DataFrame, registry: DataFrame, run: str = "") -> DataFrame:
    """Exceptions for assets not checked, checks that failed and owners that differ.

    ``registry`` has one row per plate; plates must be equal as written.
    """
    r = registry.select(
        F.col("plate").alias("_plate"), clean(F.col("status")).alias("r_status"), clean(F.col("owner")).alias("r_owner")
    )
    e = expected.select(clean(F.col("plate")).alias("plate"), clean(F.col("borrower")).alias("borrower"),
                        clean(F.col("expected_owner")).alias("expected_owner"))
    j = e.join(r, F.col("plate") == F.col("_plate"), "left")
    status = F.lower("r_status")
    missing = F.col("_plate").isNull()
    failed = status.startswith("error") | ((F.col("r_owner") == "") & status.isin("no data", ""))
    differs = (
        (F.col("expected_owner") != "") & (F.col("r_owner") != "")
        & (name_key(F.col("expected_owner")) != name_key(F.col("r_owner")))
    )
    rule = F.when(missing, "not_checked").when(failed, "check_failed").when(differs, "owner_mismatch")
    found = j.withColumn("rule", rule).filter(F.col("rule").isNotNull())
    tag = f"{run}:asset:" if run else "asset:"
    plate = F.col("plate")
    text = (
        F.when(F.col("rule") == "not_checked", F.concat(
            F.lit("Asset "), plate, F.lit(" ("), F.when(F.col("borrower") == "", "unknown borrower").otherwise(F.col("borrower")),
            F.lit(") has no registry check on file")))
        .when(F.col("rule") == "check_failed", F.concat(
            F.lit("Registry check for asset "), plate, F.lit(" returned no usable record (status: '"),
            F.when(F.col("r_status") == "", "no data").otherwise(F.col("r_status")), F.lit("')")))
        .otherwise(F.concat(
            F.lit("Asset "), plate, F.lit(": registry owner '"), F.col("r_owner"),
            F.lit("' does not match the expected owner '"), F.col("expected_owner"), F.lit("'")))
    )
    first = F.when(F.col("rule") == "check_failed", F.concat(F.lit("registry:"), plate)).otherwise(F.concat(F.lit("expected:"), plate))
    return found.select(
        "borrower", F.concat(F.lit(tag), F.col("rule"), F.lit(":"), plate).alias("id"), F.lit("asset").alias("kind"), "rule",
        F.when(F.col("rule") == "not_checked", 0.9).when(F.col("rule") == "check_failed", 0.7).otherwise(0.85).alias("severity"),
        text.alias("description"),
        F.when(F.col("rule") == "owner_mismatch", 2).otherwise(1).cast("long").alias("evidence_count"),
        first.alias("first_evidence"), F.lit("pending").alias("status"),
    )


def evidence(exceptions: DataFrame) -> DataFrame:
    """Long-form evidence of asset findings: at most two keys each."""
    plate = F.expr("substring(first_evidence, instr(first_evidence, ':') + 1)")
    keys = F.when(
        F.col("rule") == "owner_mismatch", F.array(F.concat(F.lit("expected:"), plate), F.concat(F.lit("registry:"), plate))
    ).otherwise(F.array("first_evidence"))
    return exceptions.select("borrower", F.col("id").alias("exception_id"), F.explode(keys).alias("evidence_key"))


def checked_coverage(expected: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of register rows (repeats count) with a registry result."""
    plates = registry.select("plate").distinct().withColumn("_hit", F.lit(1))
    n = expected.join(plates, "plate", "left").agg(
        F.count("_hit").alias("rows_ingested"), F.count(F.lit(1)).alias("population_size")
    )
    return n.withColumn("coverage_pct", coverage(F.col("rows_ingested"), F.col("population_size")))


def verdicts(expected: DataFrame, registry: DataFrame) -> DataFrame:
    """Bulk check summary: register row beside registry record, with lookup status and vehicle verdict."""
    r = registry.select(
        F.col("plate").alias("_plate"),
        lookup_status(clean(F.col("status")), clean(F.col("brand")), clean(F.col("owner"))).alias("status"),
        *[clean(F.col(c)).alias(c) for c in ("owner", "brand", "model")],
    )
    j = expected.join(r, F.col("plate") == F.col("_plate"), "left")
    wanted = clean(F.col("expected_vehicle"))
    return j.select(
        "plate", "borrower", "expected_owner", wanted.alias("expected_vehicle"),
        F.coalesce(F.col("status"), F.lit("(not checked)")).alias("status"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("owner", "brand", "model")],
        F.when(wanted == "", "").otherwise(containment_verdict(wanted, F.col("brand"), F.col("model"))).alias("verdict"),
    )


def verification_sheet(rows: DataFrame, with_expected: bool = True) -> DataFrame:
    """The eleven display columns."""
    have = set(rows.columns)

    def shown(source: str) -> Column:
        if source not in have or (source == "expected_vehicle" and not with_expected):
            return F.lit("")
        return F.coalesce(F.col(source).cast("string"), F.lit(""))

    return rows.select(*[shown(s).alias(name) for s, name in SHEET_COLUMNS])
