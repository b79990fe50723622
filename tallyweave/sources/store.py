"""Log, report, state and table sinks with their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.config import Thresholds
from tallyweave.operators import rank
from tallyweave.schema import RUN_LOG


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, stamped when they carry no time."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ts = F.coalesce(F.col("ts"), now) if "ts" in events.columns else now
    events.withColumn("ts", ts).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log events; a log not written yet is empty, fields outside the schema are ignored."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RUN_LOG)
    return spark.read.schema(RUN_LOG).json(path)


def report_parts(exceptions: DataFrame, limits: Thresholds) -> DataFrame:
    """Exceptions as they go into a report: with forensic and referral marks."""
    return exceptions.withColumns(
        {"forensic_review": F.col("severity") >= limits.anomaly_score_high,
         "mandatory_referral": rank.is_referral(F.col("rule"))}
    )


def report_header(runs: DataFrame, exceptions: DataFrame, limits: Thresholds) -> DataFrame:
    """One row per run: inputs and aggregates as given, with exception, forensic and referral counts."""
    counts = report_parts(exceptions, limits).groupBy("borrower").agg(
        F.count(F.lit(1)).alias("exception_count"), F.count_if("forensic_review").alias("forensic_count"),
        F.count_if("mandatory_referral").alias("referral_count"),
    )
    names = ["exception_count", "forensic_count", "referral_count"]
    return runs.join(counts, "borrower", "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)) for n in names} | {"forensic_threshold": F.lit(limits.anomaly_score_high)}
    )


def write_report(
    header: DataFrame, exceptions: DataFrame, evidence: DataFrame, path: str, limits: Thresholds, *, run: str = "run"
) -> None:
    """A run's report: header, exceptions and evidence as JSON lines by run and borrower.

    The exceptions are not packed into one document: one run may have very many.
    ``run`` names the run or batch; writing it again replaces what it wrote, so a
    retried batch leaves one report.
    """
    for part, df in (("header", header), ("exceptions", report_parts(exceptions, limits)), ("evidence", evidence)):
        df.write.mode("overwrite").partitionBy("borrower").json(f"{path}/{part}/run={run}")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report headers, one row per run; a report without a borrower counts as uploaded."""
    df = spark.read.json(f"{path}/header").drop("run")
    return df.withColumn("borrower", F.coalesce(F.nullif(F.col("borrower"), F.lit("")), F.lit("uploaded")))


def read_single_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reports kept as one JSON document each: ``run_id, status, borrower, content``."""
    raw = spark.read.option("wholetext", True).text(paths).withColumnRenamed("value", "content")
    field = lambda p: F.get_json_object("content", p)
    return raw.select(
        field("$.run_id").alias("run_id"), field("$.status").alias("status"),
        F.coalesce(F.nullif(field("$.inputs.borrower"), F.lit("")), F.lit("uploaded")).alias("borrower"), "content",
    )


def past_runs(reports: DataFrame) -> DataFrame:
    return reports.select("run_id").distinct().orderBy(F.desc("run_id"))


def export_csv(df: DataFrame, path: str) -> None:
    """Header and rows; nested columns become JSON text."""
    flat = [
        (F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def new_signoffs(requests: DataFrame, existing: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a run is signed once, by someone named, and only if its report exists.

    ``requests``: borrower, run_id, signed_by, signed_at, note. ``reports``: borrower,
    run_id, content. Among requests for one run the earliest counts.
    """
    who = F.trim(F.coalesce(F.col("signed_by"), F.lit("")))
    first = requests.groupBy("borrower", "run_id").agg(
        F.min_by(F.struct("signed_by", "signed_at", "note"), F.when(who != "", F.struct("signed_at", "signed_by"))).alias("_r"),
        F.count(F.lit(1)).alias("requests"),
    )
    old = existing.select("borrower", "run_id").distinct().withColumn("_old", F.lit(True))
    hashes = reports.select("borrower", "run_id", F.sha2(F.col("content"), 256).alias("report_sha256"))
    j = first.join(old, ["borrower", "run_id"], "left").join(hashes, ["borrower", "run_id"], "left")
    reason = (
        F.when(F.col("_r").isNull(), "no signer").when(F.col("_old"), "already signed off")
        .when(F.col("report_sha256").isNull(), "no report")
    )
    j = j.withColumn("reason", reason)
    accepted = j.filter(F.col("reason").isNull()).select(
        "run_id", "borrower", F.trim("_r.signed_by").alias("signed_by"), F.col("_r.signed_at").alias("signed_at"),
        "report_sha256", F.trim(F.coalesce("_r.note", F.lit(""))).alias("note"),
    )
    return accepted, j.filter(F.col("reason").isNotNull()).select("run_id", "borrower", "reason")


def append_signoffs(accepted: DataFrame, path: str) -> None:
    accepted.write.mode("append").partitionBy("borrower").parquet(path)
